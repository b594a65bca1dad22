"""``corpus_pipeline.run`` stage by stage against plain versions, the network's forward pass and the
pattern-instance graph among them."""

import math
import os
import re
import sys
import zlib

import numpy as np
import pytest

from riskspark.llm import packing, pii, toxicity
from riskspark.llm.common import read_table

from .test_llm import _plain_components, _plain_spans

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as cp  # noqa: E402

SF = "/root/testdata/sf0.001"
COLS = "doc_id long, text string, lang string, source string, n_chars long, row string, h string, spans int, _score int"


# ---------------------------------------------------------------- plain versions

def _hash(word: bytes) -> int:
    """The word hash of the operator, by whole numbers."""
    from riskspark.llm.common import _BYTE, _POS, SEAT
    m = 2**64

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % m
        return x ^ (x >> 31)

    total = 0
    for i, b in enumerate(word):
        x = int(_BYTE[b]) * int(_POS[i & 1023]) % m
        total += x ^ (x >> 29)
    return mix((total + len(word) * int(SEAT[63])) % m)


def _mixed(x: int) -> int:
    m = 2**64
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % m
    return x ^ (x >> 31)


def _plain_score(model: dict, text: str) -> float:
    """One window, one step, one unit of the network after the other."""
    net, vocabulary = model["net"], {int(v): i for i, v in enumerate(model["vocabulary"])}
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    inputs = []
    for w in words:
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        grams = []
        for i in range(len(low)):
            left, right = low[i - 1] if i else 1, low[i + 1] if i + 1 < len(low) else 2
            grams.append(_mixed(left << 16 | low[i] << 8 | right) % toxicity.GRAMS)
        grams += [_hash(w[:k]) % toxicity.GRAMS for k in toxicity.PREFIXES if len(w) >= k]
        own = net["word"][vocabulary.get(_hash(w), len(vocabulary))]
        inputs.append(np.concatenate([own, np.mean([net["tri"][x] for x in grams], axis=0)]).astype(np.float64))
    sig = lambda x: 1 / (1 + np.exp(-x))
    h_ = toxicity.HIDDEN
    best = -math.inf
    begins = [0] if len(words) <= toxicity.STEPS else range(0, len(words) - toxicity.STEPS + toxicity.STRIDE, toxicity.STRIDE)
    for begin in begins:
        window = inputs[begin:begin + toxicity.STEPS]
        states = {}
        for way, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            h = np.zeros(h_)
            for t in order:
                g, r = window[t] @ net[f"W{way}"] + net[f"c{way}"], h @ net[f"U{way}"]
                z, q = sig(g[:h_] + r[:h_]), sig(g[h_:2 * h_] + r[h_:2 * h_])
                n = np.tanh(g[2 * h_:] + q * r[2 * h_:])
                h = z * h + (1 - z) * n
                states[way, t] = h
        both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(window))]
        e = np.array([x @ net["u"] for x in both])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum() if len(e) else e
        pooled = sum((x * y for x, y in zip(a, both)), np.zeros(2 * h_))
        best = max(best, float(pooled @ net["w"] + net["b"][0]))
    return float(sig(model["slope"] * (best - model["cut"])))


def _plain_more(rows: list) -> list:
    """Discovered spans of each text by the pattern-instance graph, over dictionaries."""
    edges: dict = {}
    tokens = []
    for at, text in enumerate(rows):
        text = text or ""
        base = [s for k in _plain_spans(text) for s in k]
        for kind, a, b in base:
            tokens.append((at, kind, a, b, True, re.sub(r"", "", text[:a])))
        for m in re.finditer(r"(?<!\S)[^\s0-9@]*[0-9@]\S*", text):
            head = re.match(r"[^0-9A-Za-z+(\[:]*", m[0])[0]
            body = re.match(r"[^0-9A-Za-z+(\[:]*(.*?)[^0-9A-Za-z]*$", m[0])[1]
            a, b = m.start() + len(head), m.start() + len(head) + len(body)
            if any(x < b and a < y for _, x, y in base):
                continue
            tokens += [(at, kind, a, b, False, text[:m.start()]) for kind in pii.KINDS if re.search(pii.LOOKS[kind], body)]
    found = []
    for at, kind, a, b, seed, before in tokens:
        last = re.search(r"(?:(\S+)\s+)?(\S+)\s+$", before.lower())
        if last is None:
            continue
        patterns = [last[2]] + ([f"{last[1]} {last[2]}"] if last[1] else [])
        instance = rows[at][a:b].lower()
        for p in patterns:
            edges.setdefault((kind, p), {}).setdefault(instance, False)
            edges[kind, p][instance] |= seed
            found.append((at, kind, a, b, seed, p))
    known: dict = {}
    for (kind, _), have in edges.items():
        for i, seed in have.items():
            known[kind, i] = max(known.get((kind, i), 0.0), float(seed))
    trusted: dict = {}
    for _ in range(pii.ROUNDS):
        trusted = {}
        for (kind, p), have in edges.items():
            scores = [known[kind, i] for i in have]
            share, support = sum(scores) / len(scores), sum(s >= pii.CONFIDENCE for s in scores)
            if support >= pii.SUPPORT and share >= pii.CONFIDENCE:
                trusted[kind, p] = share
        reach: dict = {}
        for (kind, p), have in edges.items():
            for i, seed in have.items():
                sure, shares = reach.setdefault((kind, i), [0.0, []])
                reach[kind, i][0] = max(sure, float(seed))
                if (kind, p) in trusted:
                    shares.append(trusted[kind, p])
        known = {k: max(sure, sum(x) / len(x) if x else 0.0) for k, (sure, x) in reach.items()}
    out = [set() for _ in rows]
    for at, kind, a, b, seed, p in found:
        if not seed and (kind, p) in trusted:
            out[at].add((kind, a, b))
    return [sorted(s) for s in out]


def _plain_redact(text, more):
    if text is None:
        return None
    out, at = "", 0
    for a, b, kind in sorted([(a, b, k) for kind in _plain_spans(text) for k, a, b in kind] + [(a, b, k) for k, a, b in more]):
        if a >= at:
            out, at = out + text[at:a] + f"<{kind.upper()}>", b
        else:
            at = max(at, b)
    return out + text[at:]


def _lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def _plain_contaminated(text, items):
    words = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lowered(t))
    own = " " + " ".join(words(text)) + " "
    for item in items:
        w = words(item)
        k = min(10, len(w))
        if k and any(" " + " ".join(w[i:i + k]) + " " in own for i in range(len(w) - k + 1)):
            return True
    return False


# ---------------------------------------------------------------- the tests

def _table(spark, tmp_path, rows, labels=None):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 7, 3) for i, t in rows], COLS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read_table(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = labels if labels is not None else read_table(spark, SF, "labels")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_run_equals_the_plain_stages(spark, tmp_path, monkeypatch):
    given = [(r["doc_id"], r["text"]) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    passage = read_table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    rows = given[:120] + given[3:6] + [(5000, None), (5001, ""), (None, "no id but text to keep here"), (5002, "clean start " + passage + " end"),
                                       (5003, "mail me at some.one@example.org or +1 (017) 555-7713"), (5004, "Ünï 日本 words only")]
    rows += [(6000 + i, f"please call me at +1 (017) 555-77{i:02d} thanks {i}") for i in range(30)] + [(6100, "do call me at 555-0199-22 now")]
    sf_dir = _table(spark, tmp_path, rows)
    seen = {}
    stages = [(name, (lambda spark, docs, d, name=name, apply=apply: seen.setdefault(name, (docs, apply(spark, docs, d)))[1]))
              for name, apply in cp.STAGES]
    monkeypatch.setattr(cp, "STAGES", stages)
    places = [r.asDict() for r in cp.run(spark, sf_dir).collect()]
    got = {name: [(r["doc_id"], r["text"]) for r in before.collect()] for name, (before, _) in seen.items()}
    for name in ("near_duplicates", "decontamination", "personal_data", "packing"):
        assert seen[name][0].columns == [c.split()[0] for c in COLS.split(", ")]

    # toxicity: every text scored by hand
    model = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    scores = {t: _plain_score(model, t) for t in {t or "" for _, t in rows}}
    assert all(abs(s - 0.5) > 1e-4 for s in scores.values())
    clean = [(i, t) for i, t in rows if scores[t or ""] < 0.5]
    assert sorted(got["near_duplicates"], key=repr) == sorted(clean, key=repr) and 0 < len(clean) < len(rows)

    # near duplicates: one row of each component, the one of the smallest id
    assert got["toxicity"] and sorted(got["toxicity"], key=repr) == sorted(rows, key=repr)
    kept = got["decontamination"]
    sizes = {}
    for k, (i, n, c) in enumerate(_plain_components(clean)):
        sizes.setdefault((c, n == 0, None if n else k), []).append(i)
    assert len(kept) == len(sizes)
    assert sorted((min((x for x in ids if x is not None), default=None) for ids in sizes.values()), key=repr) == sorted((i for i, _ in kept), key=repr)

    # benchmark passages
    items = [r["text"] for r in read_table(spark, sf_dir, "benchmark").collect()]
    assert sorted(got["personal_data"], key=repr) == sorted([x for x in kept if not _plain_contaminated(x[1], items)], key=repr)
    assert 5002 not in {i for i, _ in got["personal_data"]}

    # personal data: base spans and those that the graph discovers
    docs = sorted(got["personal_data"], key=repr)
    more = _plain_more([t for _, t in docs])
    masked = sorted(((i, _plain_redact(t, m)) for (i, t), m in zip(docs, more)), key=repr)
    assert sorted(got["packing"], key=repr) == masked
    assert (6100, "do call me at <PHONE> now") in masked

    # packing: every id of every text once, sequences without gaps
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.word_bpe())
    pieces = []
    for i, t in masked:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        pieces += [(i, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in places), key=repr) == sorted(pieces, key=repr)
    by = {}
    for r in places:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 2048


def test_run_on_empty_and_one_class_tables(spark, tmp_path):
    empty = _table(spark, tmp_path / "a", [])
    assert cp.run(spark, empty).count() == 0
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    one = _table(spark, tmp_path / "b", [(i, f"text number {i} of some words") for i in range(9)], labels)
    assert {r["doc_id"] for r in cp.run(spark, one).collect()} == set(range(9))  # nothing learned, nothing rejected


def test_scores_equal_a_plain_forward_pass(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.op7_toxicity(spark, SF).collect()}
    some = docs.select("doc_id", "text").limit(40).collect()
    assert [got[r["doc_id"]] for r in some] == pytest.approx([_plain_score(model, r["text"]) for r in some], abs=1e-4)
