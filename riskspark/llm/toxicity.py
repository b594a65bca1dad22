"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 7).

A text is its words (runs of ASCII letters, digits and non-ASCII bytes, A-Z as a-z). A word's
input is the embedding of the word, if the training rows know it, beside the mean embedding of
its hashed character trigrams and beginnings. Windows of :data:`STEPS` words that overlap by half run through a
forward and a backward GRU; attention over the steps pools them into one logit. A text's score
is the logistic of a scaled largest logit over *all* its windows, so whole texts are read.

Training is in numpy on the driver, on a bounded sample: at most :data:`TRAIN_ROWS` labelled rows
per class that have a text (smallest hash of doc_id first). A text of more than :data:`TRAIN_CHARS`
bytes gives as many of its windows: a first network, of the texts below it if they have both classes and else
of evenly spread windows, scores all windows of the whole text, and the highest teach the second network.
A toxic text's label goes to its highest window (and at first to all). The trained arrays, at
most :data:`MAX_WORDS` words, are broadcast (a few MB whatever the input).

Defined results: null and empty texts score as the network scores no words; rows with a null
doc_id or label teach nothing (a null doc_id counts as held out); repeated rows score alike; if a
class has no training row every text scores the share of toxic rows, 0 without any, and no
document is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import mix, read_table, slices, small_batches, text_column, utf8, word_hashes, word_spans

STEPS, STRIDE = 24, 12
WORD_DIM, CHAR_DIM, HIDDEN = 12, 12, 8
#: Bytes of the word beginnings that count as character inputs beside the trigrams.
PREFIXES = (4, 5, 6, 7, 8)
#: Bounds of the training sample and of the model.
TRAIN_ROWS, TRAIN_CHARS, MAX_WORDS, GRAMS = 1500, 6_000, 20_000, 16384
EPOCHS, EPOCH_WINDOWS, BATCH, RATE, SEED = 6, 6000, 256, 0.02, 11
#: Share of inputs hidden from the network in training, and decay of the embeddings.
HIDE, DECAY = 0.15, 2e-4
#: Characters of training texts that are cut into words at once.
SLICE = 500_000
#: A word must be in so many training rows to have an embedding of its own.
LEAST_ROWS = 30

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- words and windows

def distinct_words(buf, s, e):
    """Place of each word among the distinct ones: hashes, first spans, inverse."""
    h = word_hashes(buf, s, e)
    if not len(h):
        return h, s, e, np.zeros(0, np.int64)
    u, first, inv = np.unique(h, return_index=True, return_inverse=True)
    return u, s[first], e[first], inv


def char_grams(buf, s, e):
    """Hashed trigrams (with a mark at both ends) and prefixes of words: buckets, and the words they belong to."""
    lens = e - s
    owner = np.repeat(np.arange(len(s)), lens)
    at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    here = np.repeat(s, lens) + at
    mid = _LOWER[buf[here]].astype(np.uint64)
    left = np.where(at > 0, _LOWER[buf[np.maximum(here - 1, 0)]], 1).astype(np.uint64)
    right = np.where(at < np.repeat(lens, lens) - 1, _LOWER[buf[np.minimum(here + 1, len(buf) - 1)]], 2).astype(np.uint64)
    h, owners = [mix((left << np.uint64(16)) | (mid << np.uint64(8)) | right)], [owner]
    for k in PREFIXES:
        long = np.flatnonzero(lens >= k)
        h.append(word_hashes(buf, s[long], s[long] + k))
        owners.append(long)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(h)[order] % np.uint64(GRAMS)).astype(np.int64), owner[order]


def windows_of(counts: np.ndarray):
    """Windows of documents with ``counts`` words: first word, words in it, document."""
    n = np.where(counts <= STEPS, 1, 1 + -(-(counts - STEPS) // STRIDE))
    doc = np.repeat(np.arange(len(counts)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum(counts) - counts
    return begin[doc] + k * STRIDE, np.minimum(STEPS, counts[doc] - k * STRIDE), doc


# ---------------------------------------------------------------- the network

def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_model(vocabulary: np.ndarray) -> dict:
    g = np.random.Generator(np.random.PCG64(SEED))
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    r = lambda *shape, scale: (g.standard_normal(shape) * scale).astype(np.float32)
    m = {"word": r(len(vocabulary) + 1, WORD_DIM, scale=0.1), "tri": r(GRAMS, CHAR_DIM, scale=0.1)}
    for way in "fb":
        m |= {f"W{way}": r(d, 3 * h, scale=d ** -0.5), f"U{way}": r(h, 3 * h, scale=h ** -0.5), f"c{way}": np.zeros(3 * h, np.float32)}
    return m | {"u": r(2 * h, scale=0.3), "w": r(2 * h, scale=0.3), "b": np.zeros(1, np.float32)}


def word_inputs(m: dict, known: np.ndarray, tri: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Input rows of n distinct words, one zero row after them for padding."""
    out = np.zeros((n + 1, WORD_DIM + CHAR_DIM), np.float32)
    out[:n, :WORD_DIM] = m["word"][known]
    if len(owner):
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        size = np.diff(np.append(begin, len(owner)))
        out[owner[begin], WORD_DIM:] = np.add.reduceat(m["tri"][tri], begin, axis=0) / size[:, None]
    return out


def _gru(gates, mask, U, steps, keep: bool):
    """One direction over gates (time, batch, 3h, inputs already applied); states by time."""
    h = np.zeros((gates.shape[1], HIDDEN), np.float32)
    states, saved = np.empty((*gates.shape[:2], HIDDEN), np.float32), []
    for t in steps:
        g = gates[t]
        r = h @ U
        zr = _sigmoid(g[:, :2 * HIDDEN] + r[:, :2 * HIDDEN])
        z, q = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(g[:, 2 * HIDDEN:] + q * r[:, 2 * HIDDEN:])
        new = n + z * (h - n)
        new = np.where(mask[t][:, None], new, h)
        if keep:
            saved.append((t, h, z, q, n, r[:, 2 * HIDDEN:]))
        states[t] = h = new
    return states, saved


def forward(m: dict, gf, gb, mask, keep: bool = False):
    """Logits of windows; gates are time x batch x 3h, mask is time x batch."""
    T = gf.shape[0]
    hf, sf = _gru(gf, mask, m["Uf"], range(T), keep)
    hb, sb = _gru(gb, mask, m["Ub"], range(T - 1, -1, -1), keep)
    H = np.concatenate([hf, hb], axis=2)
    e = np.where(mask, H @ m["u"], -30.0).astype(np.float32)
    a = np.exp(e - e.max(0))
    a *= mask
    a /= np.maximum(a.sum(0), 1e-9)
    pooled = (a[:, :, None] * H).sum(0)
    return pooled @ m["w"] + m["b"][0], (H, a, pooled, sf, sb)


def _gru_back(dstates, saved, mask, U):
    """Gradients of a direction's gates and of U."""
    dg = np.empty((*dstates.shape[:2], 3 * HIDDEN), np.float32)
    dU = np.zeros_like(U)
    dh = np.zeros(dstates.shape[1:], np.float32)
    for t, h, z, q, n, rn in reversed(saved):
        dh = dh + dstates[t]
        on = mask[t][:, None]
        d = np.where(on, dh, 0)
        dz = d * (h - n) * z * (1 - z)
        dn = d * (1 - z) * (1 - n * n)
        dq = dn * rn * q * (1 - q)
        dg[t, :, :HIDDEN], dg[t, :, HIDDEN:2 * HIDDEN], dg[t, :, 2 * HIDDEN:] = dz, dq, dn
        dr = np.concatenate([dz, dq, dn * q], axis=1)
        dU += h.T @ dr
        dh = np.where(on, d * z + dr @ U.T, dh)
    return dg, dU


def gradients(m: dict, x, mask, label):
    """Loss and gradients of a batch: x is time x batch x input."""
    flat = x.reshape(-1, x.shape[2])
    gates = {w: (flat @ m[f"W{w}"] + m[f"c{w}"]).reshape(*x.shape[:2], -1) for w in "fb"}
    logit, (H, a, pooled, sf, sb) = forward(m, gates["f"], gates["b"], mask, True)
    p = _sigmoid(logit)
    loss = float(np.mean(np.logaddexp(0, logit) - label * logit))
    d = ((p - label) / len(label)).astype(np.float32)
    g = {"w": pooled.T @ d, "b": d.sum(keepdims=True)}
    dpool = d[:, None] * m["w"]
    da = (H * dpool).sum(2)
    de = a * (da - (a * da).sum(0))
    dH = a[:, :, None] * dpool + de[:, :, None] * m["u"]
    g["u"] = np.tensordot(de, H, ([0, 1], [0, 1]))
    dx = np.zeros_like(flat)
    for w, saved, part in (("f", sf, dH[:, :, :HIDDEN]), ("b", sb, dH[:, :, HIDDEN:])):
        dg, g[f"U{w}"] = _gru_back(part, saved, mask, m[f"U{w}"])
        dg = dg.reshape(-1, 3 * HIDDEN)
        g[f"W{w}"], g[f"c{w}"] = flat.T @ dg, dg.sum(0)
        dx += dg @ m[f"W{w}"].T
    return loss, g, dx.reshape(x.shape)


# ---------------------------------------------------------------- training

class _Texts:
    """Training texts as distinct words, known places, trigrams and windows. Texts are read in slices
    of :data:`SLICE` bytes, so that beside the words' numbers only one slice's arrays are held."""

    def __init__(self, texts: list[str], vocabulary=None):
        hashes, counts, grams, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
        u, rows, ids, n_ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for some in _slices(texts):
            raw = [t.encode() for t in some]
            offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
            buf = np.frombuffer(b"".join(raw), np.uint8)
            s, e, row = word_spans(buf, offs, WORD_BYTES)
            mine, us, ue, inv = distinct_words(buf, s, e)
            hashes.append(mine[inv])
            counts.append(np.bincount(row, minlength=len(some)))
            pairs = np.unique(inv * len(some) + row)  # in how many of these texts each word stands
            new = np.flatnonzero(~np.isin(mine, u, assume_unique=True))
            tri, owner = char_grams(buf, us[new], ue[new])
            grams.append(tri.astype(np.int32))
            owners.append((owner + n_ids).astype(np.int32))
            u, ids = np.concatenate([u, mine[new]]), np.concatenate([ids, np.arange(n_ids, n_ids + len(new))])
            rows, n_ids = np.concatenate([rows, np.zeros(len(new), np.int64)]), n_ids + len(new)
            order = np.argsort(u)
            u, ids, rows = u[order], ids[order], rows[order]
            rows[np.searchsorted(u, mine)] += np.bincount(pairs // len(some), minlength=len(mine))
        words = np.concatenate(hashes)
        self.inv = np.searchsorted(u, words).astype(np.int32)
        del hashes, words
        if vocabulary is None:
            often = np.argsort(-rows, kind="stable")[:MAX_WORDS]
            vocabulary = np.sort(u[often[rows[often] >= LEAST_ROWS]])
        self.vocabulary = vocabulary
        self.known = known_places(vocabulary, u)
        place = np.empty(n_ids, np.int64)
        place[ids] = np.arange(n_ids)
        owner = place[np.concatenate(owners)] if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        self.owner = owner[order]
        self.tri = (np.concatenate(grams) if grams else np.zeros(0, np.int32))[order].astype(np.int64)
        self.n = len(u)
        self.first, self.size, self.doc = windows_of(np.concatenate(counts))

    def steps(self, pick):
        """Distinct words of windows (time x batch; n where padded) and the mask."""
        t = np.arange(STEPS)[:, None]
        mask = t < self.size[pick]
        at = np.where(mask, self.first[pick] + t, 0)
        words = self.inv[at] if len(self.inv) else np.zeros_like(at)
        return np.where(mask, words, self.n), mask


def _slices(texts: list[str]):
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= SLICE:
            yield some
            some, size = [], 0
    if some:
        yield some


def known_places(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Row of each word hash in the sorted vocabulary; the last row is for unknown words."""
    if not len(vocabulary):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, len(vocabulary))


def _scattered(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows summed by their place."""
    return np.stack([np.bincount(at, c, n) for c in rows.T], axis=1).astype(np.float32)


def train(texts: list[str], labels: np.ndarray) -> dict:
    """The model: network, vocabulary, and the scale that turns a largest logit into a score."""
    labels = np.asarray(labels, np.float32)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return {"constant": share}
    t = _Texts(texts)
    m = new_model(t.vocabulary)
    g = np.random.Generator(np.random.PCG64(SEED + 1))
    first, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    starts = np.flatnonzero(np.diff(t.owner, prepend=-1))
    sizes = np.diff(np.append(starts, len(t.owner)))
    by_word = np.split(t.tri, starts[1:]) if len(starts) else []
    toxic = labels[t.doc] == 1
    for epoch in range(EPOCHS):
        pos, neg = np.flatnonzero(toxic), np.flatnonzero(~toxic)
        few = g.choice(neg, min(EPOCH_WINDOWS, len(neg)), replace=False)
        if epoch:  # a toxic text's label is its highest window's; clean windows that score high come again
            z = window_logits(m, t)
            best = np.full(len(texts), -np.inf, np.float32)
            np.maximum.at(best, t.doc, z)
            pos = pos[z[pos] == best[t.doc[pos]]]
            few = np.unique(np.concatenate([few, neg[np.argsort(-z[neg], kind="stable")[:EPOCH_WINDOWS // 2]]]))
        neg = few
        # both classes in equal parts
        size = max(1, BATCH // 2)
        for i in range(0, len(neg), size):
            if i == 0:
                g.shuffle(neg)
            batch = np.concatenate([neg[i:i + size], g.choice(pos, size)])
            words, mask = t.steps(batch)
            u, inv = np.unique(words, return_inverse=True)
            inv = inv.reshape(words.shape)
            real = u[u < t.n]
            known = t.known[real]
            x = np.zeros((len(u), WORD_DIM + CHAR_DIM), np.float32)
            x[:len(real), :WORD_DIM] = m["word"][known]
            tri = np.concatenate([by_word[w] for w in real]) if len(real) else np.zeros(0, np.int64)
            lens = sizes[real]
            own = np.repeat(np.arange(len(real)), lens)
            if len(real):
                x[:len(real), WORD_DIM:] = np.add.reduceat(m["tri"][tri], np.cumsum(lens) - lens, axis=0) / lens[:, None]
            hide = (g.random((len(u), 2)) >= HIDE).astype(np.float32)
            hide = np.repeat(hide, [WORD_DIM, CHAR_DIM], axis=1)
            _, grad, dx = gradients(m, (x * hide)[inv], mask, labels[t.doc[batch]])
            du = _scattered(len(u), inv.reshape(-1), dx.reshape(-1, dx.shape[2])) * hide
            grad["word"] = DECAY * m["word"] + _scattered(len(m["word"]), known, du[:len(real), :WORD_DIM])
            grad["tri"] = DECAY * m["tri"] + _scattered(GRAMS, tri, (du[:len(real), WORD_DIM:] / lens[:, None])[own])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
            for k in m:
                first[k] += 0.1 * (grad[k] - first[k])
                second[k] += 0.01 * (grad[k] ** 2 - second[k])
                m[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-6)).astype(np.float32)
    z = window_logits(m, t)
    best = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(best, t.doc, z)
    return {"net": m, "vocabulary": t.vocabulary, **_scale(best, labels)}


def _scale(z: np.ndarray, y: np.ndarray) -> dict:
    """Cut with the fewest errors on the training rows (middle of its range), and the spread around it."""
    order = np.argsort(z, kind="stable")
    zs, ys = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(ys)]) + (1 - ys).sum() - np.concatenate([[0], np.cumsum(1 - ys)])
    best = np.flatnonzero(wrong == wrong.min())
    i = int(best[len(best) // 2])
    lo, hi = zs[max(0, i - 1)], zs[min(len(zs) - 1, i)]
    return {"cut": float((lo + hi) / 2), "slope": float(4 / max(1.0, np.std(zs)))}


def window_logits(m: dict, t) -> np.ndarray:
    """Logits of all windows of ``t`` in batches of bounded size."""
    x = word_inputs(m, t.known, t.tri, t.owner, t.n)
    gf, gb = x @ m["Wf"] + m["cf"], x @ m["Wb"] + m["cb"]
    out = np.empty(len(t.doc), np.float32)
    for i in range(0, len(out), 2048):
        words, mask = t.steps(np.arange(i, min(i + 2048, len(out))))
        out[i:i + 2048] = forward(m, gf[words], gb[words], mask)[0]
    return out


# ---------------------------------------------------------------- scoring

class _Slice(_Texts):
    def __init__(self, buf, offs, vocabulary):
        s, e, row = word_spans(buf, offs, WORD_BYTES)
        u, us, ue, self.inv = distinct_words(buf, s, e)
        self.known = known_places(vocabulary, u)
        self.tri, self.owner = char_grams(buf, us, ue)
        self.n = len(u)
        self.first, self.size, self.doc = windows_of(np.bincount(row, minlength=len(offs) - 1))


def score_texts(model: dict, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    if "constant" in model:
        return np.full(n, model["constant"])
    t = _Slice(buf, offs, model["vocabulary"])
    best = np.full(n, -np.inf, np.float32)
    np.maximum.at(best, t.doc, window_logits(model["net"], t))
    return _sigmoid(model["slope"] * (best.astype(np.float64) - model["cut"]))


def score(spark: SparkSession, docs: DataFrame, model: dict, name: str = "_score") -> DataFrame:
    """``docs`` (whose columns stay) with the column ``name``; the column ``text`` is read whole."""
    small_batches(spark)
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    sent = spark.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        for b in slices(batches, "text"):
            buf, offs = utf8(b.column(b.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_texts(sent.value, buf, offs))],
                                             [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def excerpts(model: dict | None, buf: np.ndarray, offs: np.ndarray) -> list[str]:
    """Of each text the windows of highest logit (without a model evenly spread ones), in their order,
    up to :data:`TRAIN_CHARS` bytes; shorter texts whole."""
    s, e, row = word_spans(buf, offs, WORD_BYTES)
    first, size, doc = windows_of(np.bincount(row, minlength=len(offs) - 1))
    begin = np.searchsorted(doc, np.arange(len(offs)))
    if model is None:
        z = -(((np.arange(len(doc)) - begin[doc]) * 0.6180339887498949) % 1)
    else:
        z = window_logits(model["net"], _Slice(buf, offs, model["vocabulary"]))
    out = []
    for i in range(len(offs) - 1):
        if offs[i + 1] - offs[i] <= TRAIN_CHARS:
            out.append(buf[offs[i]:offs[i + 1]].tobytes().decode())
            continue
        kept, left = [], TRAIN_CHARS
        for j in (begin[i] + np.argsort(-z[begin[i]:begin[i + 1]], kind="stable")).tolist():
            if not size[j]:
                break
            lo, hi = int(s[first[j]]), int(e[first[j] + size[j] - 1])
            if kept and hi - lo > left:
                break
            kept.append((lo, min(hi, lo + TRAIN_CHARS)))
            left -= hi - lo
        pieces: list[list[int]] = []
        for lo, hi in sorted(kept):
            if pieces and lo <= pieces[-1][1]:
                pieces[-1][1] = max(hi, pieces[-1][1])
            else:
                pieces.append([lo, hi])
        out.append("\n".join(buf[lo:hi].tobytes().decode(errors="ignore") for lo, hi in pieces))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Train on the bounded sample of labelled rows that are not held out and have a text."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    rows = rows.join(texts.select("doc_id"), "doc_id", "left_semi")
    ids = [rows.where(F.col("toxic") == y).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).collect()
           for y in (0, 1)]

    def sample(model):
        """(text, label, whether it is an excerpt) of the training rows."""
        def run(batches):
            for b in slices(batches, "text"):
                buf, offs = utf8(b.column(1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(excerpts(model, buf, offs), pa.string()), pa.array(np.diff(offs) > TRAIN_CHARS)],
                    ["doc_id", "text", "cut"])

        got = []
        for y in (0, 1):
            if ids[y]:
                known = docs.sparkSession.createDataFrame(ids[y], "doc_id long")
                part = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text").mapInArrow(run, "doc_id long, text string, cut boolean")
                got += [(r["text"], y, r["cut"]) for r in part.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(TRAIN_ROWS).collect()]
        return got

    got = sample(None)
    whole = [g for g in got if not g[2]]
    several = len({y for _, y, _ in whole}) == 2
    model = train(*_columns(whole if several else got))
    done = len(whole) == len(got) or "constant" in model
    del got, whole
    if done:
        return model
    return train(*_columns(sample(model)))


def _columns(rows: list) -> tuple[list[str], np.ndarray]:
    return [r[0] for r in rows], np.array([r[1] for r in rows])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    out = score(spark, text_column(docs), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame) -> DataFrame:
    """``docs`` without those that score 0.5 or more (all, if no label of one class can teach)."""
    model = fit(labelled_docs, labels)
    if "constant" in model:  # one class is absent: nothing was learned that could reject
        return docs
    # The input row travels as one column beside its text, so its columns may have any names.
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("text", F.col("row.text").cast("string"))
    return score(spark, text_column(rows), model).where(F.col("_score") < 0.5).select("row.*")
