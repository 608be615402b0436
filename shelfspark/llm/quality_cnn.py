"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of 8 bytes with stride 4 run over the whole
text, and are max-pooled over overlapping chunks of 256 bytes (every 128 bytes).
The mean and the maximum of the chunk features go through one hidden layer to
one probability. Only the bytes of the text are inputs.

Training takes a bounded sample: at most SAMPLE labelled rows of each class, the
first by a hash of the id, weighted back to the class sizes. Scoring is map-only:
the weights are broadcast (under 20 kB) and every text is read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.shared import table
from shelfspark.llm.words import chunks, text_bytes
from shelfspark.shipping import map_arrow

SAMPLE, EPOCHS, BATCH = 1500, 10, 32
#: Small samples get more epochs, for this many steps at least.
LEAST_STEPS = 900
#: Texts longer than this are left out of training (never of scoring), which bounds the sample in bytes.
LONGEST_SAMPLE = 65536
THRESHOLD = 0.7
#: Bytes of text that a task scores at once, or one text.
SCORED_BYTES = 250_000
#: Half-chunks that the filters run over at once: 250 kB of text, each byte of which takes about 100 bytes of memory meanwhile.
PIECE_HALVES = 2048
STEP, EMBED, FILTERS, HIDDEN, HALF = 4, 8, 24, 16, 32


def new_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2.0 - 1.0
    embed = np.vstack([bits * 0.5 + rng.normal(0, 0.05, (256, EMBED)), np.zeros((1, EMBED))])
    scale = lambda *shape: rng.normal(0, np.sqrt(2 / shape[0]), shape)
    made = {"embed": embed, "conv": scale(2 * STEP * EMBED, FILTERS), "conv_b": np.zeros(FILTERS), "dense": scale(2 * FILTERS, HIDDEN), "dense_b": np.zeros(HIDDEN), "out": scale(HIDDEN, 1)[:, 0], "out_b": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in made.items()}


def _laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, halves): every text padded with symbol 256 to whole half-chunks, one at least; halves are the first half-chunk of each, with the end."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // (HALF * STEP)))
    halves = np.r_[0, np.cumsum(counts)]
    symbols = np.full(halves[-1] * HALF * STEP, 256, np.int16)
    at = np.arange(len(data)) + np.repeat(halves[:-1] * HALF * STEP - offsets[:-1], sizes)
    symbols[at] = data
    return symbols, halves


def _convolved(w: dict[str, np.ndarray], symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, conv): the embedded steps, and the filters at every step; a window takes its step and the next, but for those in ``ends``."""
    x = w["embed"][symbols].reshape(-1, STEP * EMBED)
    split = STEP * EMBED
    both = x @ np.hstack([w["conv"][:split], w["conv"][split:]])
    conv = both[:, :FILTERS]
    follow = both[1:, FILTERS:].copy()
    follow[ends[ends < len(follow)]] = 0  # the last window of a text ends with it
    conv[:-1] += follow
    conv += w["conv_b"]
    return x, conv


def _pooled(half: np.ndarray, halves: np.ndarray):
    """Document features (mean and max over chunks) from the filters' maxima in every half-chunk, and what the gradient needs."""
    # a chunk is a half and the next of the same text; a text of one half is one chunk
    nxt = np.minimum(np.arange(len(half)) + 1, np.repeat(halves[1:] - 1, np.diff(halves)))
    chunk = np.maximum(half, half[nxt])
    last = (halves[1:] - 1)[np.diff(halves) > 1]
    weight = np.ones(len(half), np.float32)
    weight[last] = 0  # covered by the chunk before it
    n = np.add.reduceat(weight, halves[:-1])
    mean = np.add.reduceat(chunk * weight[:, None], halves[:-1], axis=0) / n[:, None]
    top = np.maximum.reduceat(chunk, halves[:-1], axis=0)
    return np.hstack([mean, top]), (nxt, chunk, weight, n)


def _features(w: dict[str, np.ndarray], symbols: np.ndarray, halves: np.ndarray):
    """Document features and what the gradient needs."""
    x, conv = _convolved(w, symbols, halves[1:] * HALF - 1)
    by_half = conv.reshape(-1, HALF, FILTERS)
    arg = by_half.argmax(1)
    half = np.maximum(np.take_along_axis(by_half, arg[:, None], 1)[:, 0], 0)
    features, (nxt, chunk, weight, n) = _pooled(half, halves)
    return features, (x, arg, half, nxt, chunk, weight, n)


def _head(w: dict[str, np.ndarray], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(features @ w["dense"] + w["dense_b"], 0)
    return hidden, 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_b"], -30, 30)))


def _gradient(w: dict[str, np.ndarray], texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    symbols, halves = _laid_out(np.frombuffer(b"".join(texts), np.uint8), offsets)
    features, (x, arg, half, nxt, chunk, used, n) = _features(w, symbols, halves)
    hidden, p = _head(w, features)
    d_out = ((p - y) * weight / weight.sum()).astype(np.float32)
    d_hidden = d_out[:, None] * w["out"] * (hidden > 0)
    d_feat = d_hidden @ w["dense"].T
    g = {"out": hidden.T @ d_out, "out_b": d_out.sum(keepdims=True), "dense": features.T @ d_hidden, "dense_b": d_hidden.sum(0)}
    of = np.repeat(np.arange(len(texts)), np.diff(halves))
    d_chunk = (d_feat[:, :FILTERS] / n[:, None])[of] * used[:, None]
    best = chunk == features[of, FILTERS:]
    d_chunk += d_feat[of, FILTERS:] * best / np.add.reduceat(best.astype(np.float32), halves[:-1], axis=0)[of]
    first = half >= half[nxt]
    d_half = d_chunk * first
    np.add.at(d_half, nxt, d_chunk * ~first)
    d_half *= half > 0
    g["conv_b"] = d_half.sum(0)
    at = np.arange(len(half))[:, None] * HALF + arg
    ends = np.repeat(halves[1:] * HALF - 1, np.diff(halves))[:, None]
    after = np.minimum(at + 1, len(x) - 1)
    inside = (at < ends).astype(np.float32)
    split = STEP * EMBED
    g["conv"] = np.vstack([np.einsum("hfk,hf->kf", x[at], d_half, optimize=True), np.einsum("hfk,hf->kf", x[after], d_half * inside, optimize=True)])
    d_embed = np.zeros((257, EMBED), np.float32)
    blocks = symbols.reshape(-1, STEP)
    for rows, part, scale in ((at, w["conv"][:split], d_half), (after, w["conv"][split:], d_half * inside)):
        d_x = (scale[:, :, None] * part.T[None]).reshape(-1, STEP, EMBED)
        symbol = blocks[rows].reshape(-1)
        for e in range(EMBED):
            d_embed[:, e] += np.bincount(symbol, d_x[:, :, e].reshape(-1), 257)
    d_embed[256] = 0
    g["embed"] = d_embed
    return g


def train(texts: list[str], quality: list[int], weights: list[float], epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights fitted with Adam; without rows, or with one class only, the prior of the rows decides."""
    w = new_weights(seed)
    y, sample = np.array(quality, np.float32), np.array(weights, np.float32)
    raw = [t.encode() for t in texts]
    prior = float(np.clip((y * sample).sum() / sample.sum(), 0.01, 0.99)) if len(raw) else 0.5
    w["out_b"][:] = np.log(prior / (1 - prior))
    if len(set(quality)) < 2:
        w["out"][:] = 0
        return w
    rng = np.random.default_rng(seed)
    m, v, t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    a_pass = -(-len(raw) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // a_pass))
    steps = epochs * a_pass
    for _ in range(epochs):
        order = rng.permutation(len(raw))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            g, t = _gradient(w, [raw[i] for i in pick], y[pick], sample[pick]), t + 1
            rate = 0.004 * (1 - t / (steps + 1))
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def probabilities(w: dict[str, np.ndarray], texts: pa.Array) -> np.ndarray:
    """The probability of label 1 for each text of a string array without nulls.

    The filters run over PIECE_HALVES half-chunks at a time, whatever texts these are of; a half-chunk keeps its maxima only, so a
    byte of text takes about 4 bytes of memory besides the piece's own.
    """
    data, offsets = text_bytes(texts)
    if not len(texts):
        return np.empty(0)
    symbols, halves = _laid_out(data, offsets)
    half = np.empty((halves[-1], FILTERS), np.float32)
    ends = halves[1:] * HALF - 1
    for lo in range(0, len(half), PIECE_HALVES):
        hi = min(len(half), lo + PIECE_HALVES)
        steps = slice(lo * HALF * STEP, (hi * HALF + 1) * STEP)  # a step more, for the last window
        own = ends[np.searchsorted(ends, lo * HALF) : np.searchsorted(ends, hi * HALF)] - lo * HALF
        conv = _convolved(w, symbols[steps], own)[1]
        np.maximum(conv[: (hi - lo) * HALF].reshape(-1, HALF, FILTERS).max(1), 0, out=half[lo:hi])
    return _head(w, _pooled(half, halves)[0])[1].astype(np.float64)


def held_out(id_col):
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE):
    """At most ``sample`` labelled rows of each class outside the held-out ids: (texts, labels, weights)."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = [known.where(F.col("quality") == c).orderBy(F.xxhash64("__id"), "__id").limit(sample) for c in sorted(sizes)]
    if not picks:
        return [], [], []
    chosen = picks[0] if len(picks) == 1 else picks[0].unionAll(picks[1])
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST_SAMPLE)
    rows = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).groupBy("__id").agg(F.first("quality").alias("quality"), F.min("text").alias("text")).orderBy("__id").collect()
    got = {c: sum(r["quality"] == c for r in rows) for c in sizes}
    return [r["text"] for r in rows], [r["quality"] for r in rows], [sizes[r["quality"]] / got[r["quality"]] for r in rows]


def score(docs: DataFrame, weights: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) per row of docs. Null text counts as empty and is scored too; other columns are ignored.

    Rows are scored one by one, so ids may repeat or be null and equal texts have equal scores; an empty table gives an empty
    result. Very long texts are read whole, in pieces.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1, SCORED_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(probabilities(sent.value, part.column(1)), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.7) per row of docs. A null id is not held out."""
    scored = score(docs, train(*sample_rows(docs, labels, id_col, text_col, sample)), id_col, text_col)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts; all columns stay. Scored in place, so nothing is joined."""
    weights = docs.sparkSession.sparkContext.broadcast(train(*sample_rows(docs, labels, id_col, text_col)))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, at, SCORED_BYTES):
                texts = part.column(at).fill_null("")
                yield part.filter(pa.array(probabilities(weights.value, texts) >= THRESHOLD))

    return map_arrow(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
