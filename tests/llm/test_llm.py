"""Small cases of every training-data operator: nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns, against plain versions."""

import hashlib
import os
import re
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskspark.llm import (ann, chat, decontam, jaccard, language, license, packing, pii, tokenfiles, toxicity)
from riskspark.llm.common import read_table, utf8, word_hashes, word_spans

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, g string, node int"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
ROWS = [(1, "the cat sat on the mat and slept all day long in the sun"), (2, None), (3, ""), (4, "Two words"), (5, LONG),
        (6, "THE cat sat on the mat and slept all day long in the sun"), (6, "the cat sat on the mat and slept all day long in the sun"),
        (None, "the cat sat on the mat and slept all day long in the sun"), (None, None), (9, "  \t\n "), (5, LONG),
        (11, "日本語 テキスト é ü 🙂 \x1c odd space"), (12, "the cat sat on the mat and slept all day long in the rain")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1) for i, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


# ---------------------------------------------------------------- 1

def _sets(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def _plain_components(rows):
    sets, n = _sets(rows), len(rows)
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[label[k]] = min(i, low.get(label[k], i))
    return sorted(((i, len(s), low.get(label[k])) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def test_jaccard_edge_cases(spark, docs, empty):
    got = jaccard.jaccard_components(spark, docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == _plain_components(ROWS)
    assert jaccard.jaccard_components(spark, empty).count() == 0


def test_jaccard_family_of_near_copies(spark):
    g = np.random.Generator(np.random.PCG64(3))
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in g.choice(len(w), int(g.integers(0, 9)), replace=False):
            w[at] = f"x{g.integers(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:50] + [f"q{i}w{j}" for j in range(60)])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(spark, df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == _plain_components(rows)


def test_jaccard_blocks_of_an_opened_group(spark, monkeypatch):
    """A group cut into many blocks, asked by texts near 75 %: every link of brute force is found."""
    monkeypatch.setattr(jaccard, "BLOCK", 300)
    monkeypatch.setattr(jaccard, "ASKERS", 500)
    g = np.random.Generator(np.random.PCG64(7))
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in g.choice(len(w), int(g.integers(2, 9)), replace=False):
            w[at] = f"y{g.integers(12)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(spark, df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == _plain_components(rows)

    sets = {i: set(jaccard.shingle_sets(*jaccard.utf8(jaccard.pa.array([t])))[0].view(np.int64).tolist()) for i, t in rows}
    tokens = spark.createDataFrame([(t, i, 1 if i < 100 else i, len(x)) for i, x in sets.items() for t in x],
                                   "token long, node long, g long, n long")
    opened = spark.createDataFrame([(i, 1) for i in range(100, 120)], "node long, other long")
    got = {(r["a"], r["b"]) for r in jaccard.linked_in_blocks(opened, tokens).collect()}
    assert got == {(a, b) for a in range(100) for b in range(100, 120)
                   if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert got


def test_jaccard_dealt_rows_stay_small(spark):
    """A piece is one row of a shuffle (2 MB before): at most 10,000 tokens of 8 bytes, of ranges and shared tokens alike."""
    texts = [" ".join(f"w{i % 3}x{k}" for k in range(20_000)) + f" end{i}" for i in range(12)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = jaccard.dealt_prefix_tokens(df, 1).select("part", F.length("tokens").alias("t"), F.length("nodes").alias("n"),
                                                    F.length("sizes").alias("s"), F.length("many").alias("m")).collect()
    assert {r["part"] for r in got} == {0, 1}
    assert all(r["t"] == r["n"] == 2 * r["s"] == 8 * r["m"] <= 80_000 for r in got)
    pairs = [(r["token"], r["node"]) for r in jaccard.shared_prefix_tokens(df, 1).collect()]
    buf, offs = utf8(pa.array(texts))
    sets = {jaccard.node_of(x): x[:jaccard.prefix_size(len(x))].view(np.int64).tolist() for x in jaccard.shingle_sets(buf, offs)}
    often = Counter(t for x in sets.values() for t in x)
    assert sorted(pairs) == sorted((t, node) for node, x in sets.items() for t in x if often[t] > 1)


def test_word_hashes_take_memory_of_a_bounded_piece():
    """Making the hashes of 4 MB of words took some 50 bytes for each byte at once."""
    text = " ".join(["a", "Bc", "x" * 3_000, "\u00e9t\u00e9", "y" * 250_000] + [f"w{i % 997}" for i in range(700_000)])
    buf, offs = utf8(pa.array([text, "", "Bc a"]))
    starts, ends, _ = word_spans(buf, offs, jaccard.NO_SPACE)
    tracemalloc.start()
    got = word_hashes(buf, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(buf)
    assert got[-2:].tolist() == got[[1, 0]].tolist() and len(set(got.tolist())) == 997 + 5
    few = np.r_[0:20, len(starts) - 5:len(starts)]
    assert [word_hashes(buf, starts[i:i + 1], ends[i:i + 1])[0] for i in few] == got[few].tolist()
    assert not len(word_hashes(buf, starts[:0], ends[:0]))


def test_jaccard_tokens_of_several_nodes_spread_over_groups(spark):
    """Tokens that each of many small partitions saw in several nodes do not meet in one group."""
    rows = [(" ".join(f"p{p}w{j}" for j in range(40)) + f" end{k}",) for p in range(32) for k in range(3)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 32), "text string")
    dealt = jaccard.dealt_prefix_tokens(df, 8)
    size = dealt.selectExpr("part", "length(tokens) as size").where("part >= 8").groupBy("part").sum("size").collect()
    assert len(size) >= 5 and max(s for _, s in size) <= 0.4 * sum(s for _, s in size)
    held = {}
    for (t,) in rows:
        x = jaccard.shingle_sets(*jaccard.utf8(jaccard.pa.array([t])))[0]
        for k in x[:jaccard.prefix_size(len(x))].view(np.int64).tolist():
            held.setdefault(k, set()).add(jaccard.node_of(x))
    got = [(r["token"], r["node"]) for r in jaccard.shared_prefix_tokens(df, 8).collect()]
    assert sorted(got) == sorted((k, n) for k, nodes in held.items() if len(nodes) > 1 for n in nodes)


def test_keep_one(spark, docs):
    kept = jaccard.keep_one(spark, docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([1, 2, 3, 4, 5, 9, 11, 12, None], key=repr) or 12 not in ids


def test_keep_one_tells_components_of_one_id_apart(spark):
    """Unrelated texts without an id, or with the same id, are components of their own; empty texts too."""
    text = lambda k: " ".join(f"{k}w{j}" for j in range(20))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (7, text("d")), (7, text("e")),
            (8, text("e")), (3, text("f") + " end"), (None, text("f")), (None, None), (None, ""), (None, " \t"), (4, ""), (4, "")]
    kept = jaccard.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (3, text("f") + " end"),
            (None, None), (None, ""), (None, " \t"), (4, ""), (4, "")]
    assert sorted(map(tuple, kept), key=repr) == sorted(want, key=repr)


# ---------------------------------------------------------------- 2

def test_language(spark, docs, empty):
    d = read_table(spark, SF, "documents")
    got = language.op2_language(spark, SF).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    models = language.fit(spark, d.select("doc_id", "lang", "text"))
    out = {r["doc_id"]: r for r in language.identify(spark, docs, models).collect()}
    assert out[2]["lang_pred"] == out[9]["lang_pred"] == "und" and out[2]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert language.fit(spark, empty) is None
    assert {r["lang_pred"] for r in language.identify(spark, docs, None).collect()} == {"und"}
    assert language.identify(spark, empty, models).count() == 0


# ---------------------------------------------------------------- 3

def test_licences(spark, empty):
    t = license.TEMPLATES
    f = spark.createDataFrame([
        ("a/LICENSE", 1, t["MIT"], 0), ("a/b/c.txt", 2, "hello world", 0), ("a/b/d/COPYING.txt", 3, t["GPL-3.0"], 0),
        ("a/b/d/e/x.py", 4, None, 0), ("z.py", 5, "x", 0), (None, 6, "MIT", 0), ("a/y.py", 7, "# " + t["CC-BY-NC-4.0"] + "\ncode here and more words that are no licence at all", 0),
        ("q/NOTICE", 8, "nothing", 0), ("a/b/c.txt", 2, "hello world", 0)], "path string, row long, text string, own int")
    got = sorted(((r["row"], r["own"], r["licence"], r["source_path"]) for r in license.scan_licences(spark, f).collect()), key=repr)
    assert got == sorted([
        (1, "MIT", "MIT", "a/LICENSE"), (2, None, "MIT", "a/LICENSE"), (2, None, "MIT", "a/LICENSE"),
        (3, "GPL-3.0", "GPL-3.0", "a/b/d/COPYING.txt"), (4, None, "GPL-3.0", "a/b/d/COPYING.txt"), (5, None, None, None),
        (6, None, None, None), (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0", "a/y.py"), (8, None, None, None)], key=repr)
    assert license.scan_licences(spark, empty.select(license.document_path().alias("path"), empty.doc_id.alias("row"), "text")).count() == 0


def test_licences_of_documents(spark):
    rows = {r["doc_id"]: r["own"] for r in license.op3_licences(spark, SF).collect()}
    for r in read_table(spark, SF, "documents").collect():
        found = {n for n, t in license.TEMPLATES.items() if t in (r["text"] or "").split("\n")}
        assert not found or rows[r["doc_id"]] in found


# ---------------------------------------------------------------- 4, 6

def _ids(path, texts, end):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array(e.ids + [end], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def test_special_token_strings_as_the_library_has_them():
    from tokenizers import Tokenizer
    from riskspark.llm.tokens import ChunkEncoder
    texts = ["<|endoftext|>", "one <|endoftext|> two", "one<|endoftext|>two.", "a  <|startoftext|>  b <|endoftext|>\n<|endoftext|> c",
             "Plain words, and <|endoftext|", " <|startoftext|>x <|endoftext|> ", "\t<|endoftext|> \u3000<|endoftext|> é"]
    for path, words in ((tokenfiles.byte_bpe(), False), (packing.word_bpe(), True)):
        plain, ours = Tokenizer.from_file(path), ChunkEncoder(path, words)
        special = {plain.token_to_id("<|endoftext|>")}
        for t, got in zip(texts, ours.encode(texts)):
            assert np.frombuffer(got, ours.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids
        assert special <= set(np.frombuffer(ours.encode(texts[:1])[0], ours.dtype).tolist())


def test_token_files(spark, docs, empty):
    files = tokenfiles.TokenFiles.write(spark, docs, tokenfiles.byte_bpe())
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in files.read(docs).collect()]
    plain = _ids(tokenfiles.byte_bpe(), [t or "" for _, t in ROWS], 2)
    want = sorted(((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(ROWS, plain)), key=repr)
    assert sorted(((i, n, c) for i, _, n, c in got), key=repr) == want
    at = 0
    for i, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [i for i, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    assert files.read(spark.createDataFrame([(777,), (4,)], "doc_id long")).count() == 1
    none = tokenfiles.TokenFiles.write(spark, empty, tokenfiles.byte_bpe())
    assert none.read(docs).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.Generator(np.random.PCG64(1)).integers(0, 2**63, 5000).astype(np.uint64))
    mph, _ = tokenfiles.PerfectHash.load(tokenfiles.PerfectHash.build(keys).dump())
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))


def test_packing(spark, docs, empty):
    places, pieces = packing.pack(spark, docs, packing.word_bpe(), 64)
    got = [r.asDict() for r in places.collect()]
    by = {}
    for (i, _), x in zip(ROWS, _ids(packing.word_bpe(), [t or "" for _, t in ROWS], 1)):
        for s in range(0, len(x), 64):
            by.setdefault((i, s, len(x[s:s + 64]), zlib.crc32(x[s:s + 64].tobytes()), len(x)), []).append(1)
    want = sorted((k for k, v in by.items() for _ in v), key=repr)
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got), key=repr) == want
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 64
    assert packing.pack(spark, empty, packing.word_bpe())[0].count() == 0


def test_histogram_packing_places_all():
    g = np.random.Generator(np.random.PCG64(5))
    u, c = np.unique(np.minimum(2048, g.lognormal(6, 1.2, 20000).astype(int) + 1), return_counts=True)
    h = dict(zip(u.tolist(), c.tolist()))
    patterns = packing.pack_histogram(h)
    back = {}
    for n, lengths in patterns:
        assert sum(lengths) <= 2048
        for x in lengths:
            back[x] = back.get(x, 0) + n
    assert back == h
    assert 1 - sum(k * v for k, v in h.items()) / (2048 * sum(n for n, _ in patterns)) < 0.01


# ---------------------------------------------------------------- 5

def test_decontamination_blocks_and_short_items(spark, docs, empty):
    items = [(1, "sat on the mat and slept all day long in the sun", "z"), (2, "TWO, words!", "z"), (3, None, "z"), (3, "", "z"),
             (None, "slept all", "z"), (10, "dolor sit amet consectetur lorem ipsum dolor sit amet consectetur lorem", "z"),
             (1, "sat on the mat and slept all day long in the sun", "z")]
    whole = sorted(map(str, decontam.find_hits(spark, docs, _bench(spark, items)).collect()))
    blocks = sorted(map(str, decontam.find_hits(spark, docs, _bench(spark, items), block=2).collect()))
    assert whole == blocks
    by = {}
    for r in decontam.find_hits(spark, docs, _bench(spark, items)).collect():
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], r["items"]))
    assert by[1] == [(14, 12, ["1"])] and by[4] == [(2, 2, ["2"])] and by[2] == [(0, 0, [])]
    assert by[12] == [(14, 11, ["1"])] and by[5] == [(24000, 23998, ["10"])] * 2 or by[5][0][1] > 23000
    assert decontam.find_hits(spark, docs, _bench(spark, [])).where("n_hit > 0").count() == 0
    assert decontam.find_hits(spark, empty, _bench(spark, items)).count() == 0
    kept = decontam.remove_documents(spark, docs, _bench(spark, items))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 9, 11, None}
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_spans(spark, docs, _bench(spark, items)).collect()}
    assert cut[1] == "the cat \n\n" and cut[9] == "  \t\n "


# ---------------------------------------------------------------- 7

def test_toxicity_learns_and_scores_all_windows(spark, docs, empty):
    g = np.random.Generator(np.random.PCG64(2))
    word = lambda: "".join(g.choice(list("abcdefgh"), 4))
    texts, labels = [], []
    for i in range(240):
        w = [word() for _ in range(60)]
        if i % 3 == 0:
            w[int(g.integers(60))] = w[int(g.integers(60))] = "vilestuff"
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts, np.array(labels))
    late = " ".join(word() for _ in range(900))
    df = spark.createDataFrame([(1, late + " VILESTUFF, vilestuff " + late, 0), (2, late, 0), (3, None, 0), (4, "", 0)], "doc_id long, text string, x int")
    from riskspark.llm.common import text_column
    s = {r["doc_id"]: r["_score"] for r in toxicity.score(spark, text_column(df), model).collect()}
    assert s[1] > 0.5 > s[2] and s[3] == s[4] and all(0 <= v <= 1 for v in s.values())
    assert toxicity.score(spark, text_column(empty), model).count() == 0
    assert toxicity.train(["a"], np.array([1])) == {"constant": 1.0} and toxicity.train([], np.array([])) == {"constant": 0.0}


def test_toxicity_learns_from_long_texts_and_rejects_nothing_without_a_class(spark):
    g = np.random.Generator(np.random.PCG64(8))
    words = ["".join(g.choice(list("abcdefgh"), 4)) for _ in range(300)]
    rows, marks = [], []
    for i in range(400):
        w = g.choice(words, 1400).tolist()  # 7,000 characters
        if i % 2:
            at = int(g.integers(len(w) - 12))
            w[at:at + 12] = ["vilestuff"] * 12
        rows.append((i, " ".join(w)))
        marks.append((i, i % 2))
    assert min(len(t) for _, t in rows) > toxicity.TRAIN_CHARS
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    kept = {r["doc_id"] for r in toxicity.keep_clean(spark, docs, labels, docs).collect()}
    assert sum(i % 2 == 0 for i in kept) >= 190 and sum(i % 2 for i in kept) <= 10
    assert toxicity.keep_clean(spark, docs, labels.where("toxic = 1"), docs).count() == 400


def test_gradients_match_differences():
    g = np.random.Generator(np.random.PCG64(4))
    m = {k: v.astype(np.float64) for k, v in toxicity.new_model(np.arange(3, dtype=np.uint64)).items()}
    x = g.standard_normal((5, 4, toxicity.WORD_DIM + toxicity.CHAR_DIM)) * 0.5
    mask = np.arange(5)[:, None] < np.array([5, 3, 1, 4])
    y = np.array([1, 0, 1, 0])
    _, grad, _ = toxicity.gradients(m, x, mask, y)
    for k in ("Wf", "Ub", "u", "w", "cb"):
        at = tuple(0 for _ in m[k].shape)
        old = m[k][at]
        two = []
        for d in (0.03, -0.03):
            m[k][at] = old + d
            two.append(toxicity.gradients(m, x, mask, y)[0])
        m[k][at] = old
        assert abs((two[0] - two[1]) / 0.06 - grad[k][at]) < 2e-3


# ---------------------------------------------------------------- 8

def test_chat_folds_events(spark):
    log = spark.createDataFrame([
        (1, 0, 0, "message", "user", "hi <b> \\l"), (1, 1, 0, "message", "assistant", ""), (1, 1, 1, "delta", None, "dra"),
        (1, 1, 2, "delta", None, "ft"), (1, 1, 3, "regenerate", None, ""), (1, 1, 4, "delta", None, "final </turn>"),
        (1, 2, 0, "message", "user", "x"), (1, 2, 1, "edit", None, "y"), (1, 3, 0, "message", "user", "gone"),
        (1, 3, 1, "delete", None, None), (None, 0, 0, None, None, None)],
        "conv_id long, message_id long, seq long, kind string, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold_events(log))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "hi <b> \\l"), ("assistant", "final </turn>"), ("user", "y")]
    assert got[1]["learned"] == "final </turn>" and [tuple(t) for t in got[None]["turns"]] == [("", "")]
    assert chat.render(chat.fold_events(log.limit(0))).count() == 0


def test_chat_has_no_python_nodes(spark):
    plan = chat.op8_chat_format(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- 9

def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _plain_spans(t):
    out = [[("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]]
    out.append([("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m[0].split("."))) <= 255])
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out.append([("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and _luhn(digits(m))])
    out.append([("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15])
    return out


PII = ["a@b.c+d@e.f x@y z@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1..2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112 12 34",
       "+1 (017) 555-7713 rest +49.30.123 +1 2", "🙂é 10.0.0.1 é🙂 me@x.org", "9" * 30000, "a." * 3000 + "@", "1." * 5000, None, "", "+" * 3000]


def test_pii_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(PII)) + [(None, PII[4]), (0, PII[0])], "doc_id long, text string")
    for r in pii.find_pii(spark, df).collect():
        want = _plain_spans(PII[r["doc_id"] if r["doc_id"] is not None else 4] or "")
        for k, w in zip(pii.KINDS, want):
            assert [(k, s["first"], s["past"]) for s in r[k]] == w
    assert pii.find_pii(spark, df.limit(0)).count() == 0


def test_pii_discovers_behind_trusted_patterns(spark):
    rows = [(i, f"alpha beta call me at +1 (017) 555-77{i:02d} thanks") for i in range(30)]
    rows += [(100, "please call me at 555-0199-22 thanks"), (101, "the year 555-0199-22 is nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS lang", "length(text) AS n_chars")
    more = {r["doc_id"]: r["more"] for r in pii.find_pii(spark, df).collect()}
    assert [tuple(s) for s in more[100]] == [("phone", 18, 29)] and more[101] == []
    clean = {r["doc_id"]: r for r in pii.redact(spark, df).collect()}
    assert clean[100]["text"] == "please call me at <PHONE> thanks" and clean[3]["text"] == "alpha beta call me at <PHONE> thanks"
    assert clean[100]["n_chars"] == len(clean[100]["text"]) and clean[101]["text"] == rows[-1][1]


def test_pii_query_lists_spans(spark):
    docs = {r["doc_id"]: r["text"] for r in read_table(spark, SF, "documents").collect()}
    df = pii.op9_pii(spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in df.collect():
        want = ",".join(f"{k}:{a}:{b}" for part in _plain_spans(docs[r["doc_id"]]) for k, a, b in part)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


# ---------------------------------------------------------------- 10

def test_nearest_recall_and_edge_cases(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in read_table(spark, SF, "embeddings").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    norm = np.sqrt((x * x).sum(1))
    got = {}
    for r in ann.op10_nearest(spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = []
    for q, found in got.items():
        s = (x * x[ids == q][0]).sum(1) / norm / norm[ids == q][0]
        s[ids == q] = -9
        hits.append(len(set(ids[np.lexsort((ids, -s))[:5]]) & {v for _, v, _ in found}) / 5)
        assert [r for r, *_ in sorted(found)] == [1, 2, 3, 4, 5]
    assert len(got) == sum(i % 50 == 0 for i in ids) and np.mean(hits) >= 0.9
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]),
                                 (6, [1.0, None]), (7, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (2, [3.0, 0.0]), (8, [])], "vec_id long, v array<double>")
    index = ann.valid_vectors(odd, "vec_id", "v")
    res = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(spark, index, index.where("vec_id % 50 = 0")).collect())
    assert res == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert ann.nearest(spark, index.limit(0), index.limit(0)).count() == 0


def test_nearest_small_blocks_and_repeated_ids(spark):
    """Blocks of few vectors are searched whole, and repeats of the query's id do not end the ascent."""
    g = np.random.Generator(np.random.PCG64(5))
    tables = [[(i, g.standard_normal(16)) for i in range(n)] for n in (3, 20, 48, 100)]
    same, own = g.standard_normal(16), g.standard_normal(16)
    tables.append([(i, g.standard_normal(16)) for i in range(1, 241)] + [(0, same)] * 100)
    tables.append([(i, g.standard_normal(16)) for i in range(1, 241)] + [(0, own + 0.01 * g.standard_normal(16)) for _ in range(120)])
    for rows in tables:
        df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, v array<double>")
        asked = df.where("vec_id = 0").limit(1)
        first = np.array(asked.first()["v"])
        best = {}
        for i, v in rows:
            if i:
                s = float(v @ first / np.sqrt((v @ v) * (first @ first)))
                best[i] = max(s, best.get(i, -2.0))
        want = sorted(best, key=lambda i: (-best[i], i))[:5]
        got = ann.nearest(spark, df, asked).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))
    # one block of 4,096 with a third of one id: the share of the other ids met is that of any query
    rows = [(i, g.standard_normal(16)) for i in range(1, 2731)] + [(0, own + 0.01 * g.standard_normal(16)) for _ in range(1366)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, v array<double>")
    asked = df.where("vec_id = 0").limit(5)
    assert ann.nearest(spark, df.coalesce(1), asked).count() == 25


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline as cp

    docs = read_table(spark, SF, "documents")
    clean = cp.drop_near_duplicates(spark, docs, SF)
    assert clean.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted({c for i, n, c in _plain_components(rows)})
    assert sorted(r["doc_id"] for r in clean.collect()) == want
    left = cp.drop_contaminated(spark, docs, SF)
    bad = {r["doc_id"] for r in decontam.op5_decontaminate(spark, SF).where("contaminated").collect()}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({i for i, _ in rows} - bad)
    masked = cp.mask_personal_data(spark, docs, SF)
    assert masked.columns == docs.columns
    for r in masked.collect():
        assert not any(_plain_spans(r["text"])[:2][0])
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
