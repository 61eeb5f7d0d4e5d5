"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

States are O (0) and TOXIC (1). A token's features are hashes of its stripped, folded form, its first bytes and
its last bytes. Tokens are labelled from documents: in a toxic training document a token is toxic when one of
its features is typical of toxic documents, counted over different neighbourhoods so that copies of one text
count once. Tokens without a known feature all have the same potentials, so runs of them are one matrix power
and the exact forward-backward pass visits only tokens that have a known feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.textnp import mix, part_hashes, text_batches, tidied, tidy, token_spans, utf8
from lintlake.plans.lineage import bounded_batches

#: The bounded sample of labelled rows: so many of each label, by hash of doc_id, of texts of at most so many characters.
TRAIN_DOCS = 2000
TRAIN_CHARS = 20_000
#: Least number of neighbourhoods and share of toxic ones that make a feature typical.
MIN_CONTEXTS = 10
MIN_SHARE = 0.9
#: Tokens on each side of a training window, windows worked on at a time, rounds of training, shrinkage.
SIDE = 6
WINDOWS = 20_000
ROUNDS = 80
SHRINK = 1e-4
#: Texts and tokens that training turns into features at a time.
SLICE_TEXTS, SLICE_TOKENS = 64, 1 << 16

PREFIXES = (4, 5, 6)
SUFFIX = 5

_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    transitions: np.ndarray  # log potentials, from row to column
    scale: tuple[float, float] = (1.0, 0.0)  # of the logistic on the logit of the document's probability


def token_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of tokens (outer punctuation stripped), first token per row, features (tokens x kinds).

    A part as long as the token itself is not a feature of its own (0).
    """
    starts, ends, first = token_spans(buf, offsets)
    s, e = starts.copy(), ends.copy()
    for _ in range(3):
        e = np.where((e - s > 1) & _PUNCT[buf[np.maximum(e - 1, 0)]], e - 1, e) if len(e) else e
        s = np.where((e - s > 1) & _PUNCT[buf[np.minimum(s, max(len(buf) - 1, 0))]], s + 1, s) if len(s) else s
    parts = [(s, e)] + [(s, np.minimum(s + k, e)) for k in PREFIXES] + [(np.maximum(e - SUFFIX, s), e)]
    out = np.zeros((len(s), len(parts)), np.uint64)
    for k, h in enumerate(part_hashes(buf, starts, ends, parts)):
        salt = mix(np.array([k + 41], np.uint64))[0]
        own = np.ones(len(s), bool) if k == 0 else (e - s) > (PREFIXES[k - 1] if k <= len(PREFIXES) else SUFFIX)
        out[:, k] = np.where(own, mix(h ^ salt), np.uint64(0))
    return s, e, first, out


def _known(model_features: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Index of each feature in the model, -1 if it has none."""
    out = np.full(features.shape, -1, np.int32)
    if not len(model_features):
        return out
    table = np.zeros(1 << 18, bool)
    table[(model_features >> np.uint64(46)).astype(np.int64)] = True
    maybe = table[(features >> np.uint64(46)).astype(np.int64)]
    asked = features[maybe]
    at = np.minimum(np.searchsorted(model_features, asked), len(model_features) - 1)
    out[maybe] = np.where(model_features[at] == asked, at, -1)
    return out


def typical_features(features: np.ndarray, row: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Sorted hashes of the features found mostly in toxic rows, each neighbourhood counted once."""
    word = features[:, 0]
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[first[:-1][first[:-1] < len(word)]] = 0
    context = mix(mix(before) + after)
    label = toxic[row].astype(bool)
    found = []
    totals = [max(1, int((~label).sum())), max(1, int(label.sum()))]
    for k in range(features.shape[1]):
        have = features[:, k] != 0
        f, c, y = features[have, k], context[have], label[have]
        counts = []
        for value in (False, True):
            one, near = f[y == value], c[y == value]
            _, at = np.unique(mix(one ^ mix(near)), return_index=True)
            counts.append(np.unique(one[at], return_counts=True))
        (fc, nc), (ft, nt) = counts
        at = np.minimum(np.searchsorted(fc, ft), max(len(fc) - 1, 0))
        clean = np.where(fc[at] == ft, nc[at], 0) if len(fc) else np.zeros(len(ft), int)
        share = nt / (nt + (clean + 0.0) * totals[1] / totals[0])
        good = (nt >= MIN_CONTEXTS) & (share >= MIN_SHARE)
        found.append(ft[good])
    return np.unique(np.concatenate(found))


def _emissions(known: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    padded = np.append(weights, 0.0)
    return padded[known].sum(axis=-1) + bias


def _chain(emit: np.ndarray, trans: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of TOXIC (n, t) and expected transitions (2, 2) of equal-length windows with padding."""
    n, t = emit.shape
    a = np.exp(trans)
    pot = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], 2)
    fwd, bwd = np.empty((n, t, 2)), np.empty((n, t, 2))
    fwd[:, 0] = pot[:, 0]
    for i in range(1, t):
        v = (fwd[:, i - 1] @ a) * pot[:, i]
        v = np.where(real[:, i, None], v, fwd[:, i - 1])
        fwd[:, i] = v / v.sum(1, keepdims=True)
    bwd[:, -1] = 1
    for i in range(t - 2, -1, -1):
        v = (bwd[:, i + 1] * pot[:, i + 1]) @ a.T
        v = np.where(real[:, i + 1, None], v, bwd[:, i + 1])
        bwd[:, i] = v / v.sum(1, keepdims=True)
    m = fwd * bwd
    m = m[:, :, 1] / m.sum(2)
    expected = np.zeros((2, 2))
    for i in range(1, t):
        joint = fwd[:, i - 1, :, None] * a[None] * (pot[:, i] * bwd[:, i])[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        expected += (joint * real[:, i, None, None]).sum(0)
    return m, expected


def train_crf(known: np.ndarray, labels: np.ndarray, first: np.ndarray, n_features: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum likelihood by Adam on windows around tokens with known features and on evenly spaced ones."""
    total = len(labels)
    active = np.flatnonzero((known >= 0).any(1))
    spaced = np.arange(0, total, max(1, total // max(2000, len(active))))
    centres = np.concatenate([active, spaced])
    row = np.searchsorted(first, centres, "right") - 1
    at = centres[:, None] + np.arange(-SIDE, SIDE + 1)[None]
    real = (at >= first[row][:, None]) & (at < first[row + 1][:, None])
    # padding stands last: windows are shifted so that the first place is real
    shift = np.argmax(real, axis=1)
    at = at + shift[:, None]
    real = (at >= first[row][:, None]) & (at < first[row + 1][:, None])
    at = np.clip(at, 0, max(total - 1, 0))
    f, y = np.where(real[:, :, None], known[at], -1), labels[at] * real
    w, b, trans = np.zeros(n_features), -2.0, np.zeros((2, 2))
    if not len(centres):
        return w, b, trans
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
    n_w = len(centres)
    state = [np.zeros(n_features + 5), np.zeros(n_features + 5)]
    for k in range(1, ROUNDS + 1):
        gw, gb, expected = np.zeros(n_features), 0.0, np.zeros((2, 2))
        for at in range(0, n_w, WINDOWS):
            part = slice(at, at + WINDOWS)
            m, moves = _chain(_emissions(f[part], w, b), trans, real[part])
            rest = (y[part] - m) * real[part]
            flat = f[part].reshape(-1)
            use = flat >= 0
            gw += np.bincount(flat[use], np.repeat(rest.reshape(-1), f.shape[2])[use], n_features)
            gb, expected = gb + rest.sum(), expected + moves
        g = np.concatenate([gw / n_w - SHRINK * w, [gb / n_w], ((observed - expected) / n_w).ravel() - SHRINK * trans.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = 0.15 * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-8)
        w += move[:n_features]
        b += move[n_features]
        trans += move[n_features + 1 :].reshape(2, 2)
    return w, float(b), trans


def marginals(model: Model, known: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token indexes with a known feature and their exact probability of being toxic, given the whole row."""
    at = np.flatnonzero((known >= 0).any(1))
    if not len(at):
        return at, np.zeros(0)
    emit = np.exp(np.clip(_emissions(known[at], model.weights, model.bias), -30, 30))
    a = np.exp(model.transitions)
    step = a * np.array([1.0, np.exp(model.bias)])[None, :]  # one neutral token: move, then emit
    values, vectors = np.linalg.eig(step)
    order = np.argsort(-np.abs(values))
    values, vectors = values[order].real, vectors[:, order].real
    inverse = np.linalg.inv(vectors)
    main = np.outer(vectors[:, 0], inverse[0])
    other = np.outer(vectors[:, 1], inverse[1])
    ratio = values[1] / values[0]

    def power(gap: np.ndarray) -> np.ndarray:
        """step ** gap up to a factor, for each gap."""
        return main[None] + (np.sign(ratio) ** gap * np.abs(ratio) ** gap)[:, None, None] * other[None]

    row = np.searchsorted(first, at, "right") - 1
    lead = np.ones(len(at), bool)
    lead[1:] = row[1:] != row[:-1]
    heads = np.flatnonzero(lead)
    counts = np.diff(np.append(heads, len(at)))
    pot = np.stack([np.ones(len(at)), emit], 1)
    # before the first known token: neutral tokens from a flat start, then one move
    gap0 = at[heads] - first[row[heads]]
    begin = np.where(
        (gap0 == 0)[:, None], 1.0,
        (np.array([1.0, np.exp(model.bias)])[None, None] @ power(np.maximum(gap0 - 1, 0)))[:, 0] @ a,
    )
    after = power(first[row[heads] + 1] - 1 - at[heads + counts - 1]).sum(2)
    gaps = np.zeros(len(at), np.int64)
    gaps[1:] = at[1:] - at[:-1] - 1
    gaps[heads] = 0
    between = power(gaps) @ a  # from the token before to this one
    fwd, bwd = np.empty((len(at), 2)), np.empty((len(at), 2))
    order = np.argsort(-counts, kind="stable")
    v = begin * pot[heads]
    fwd[heads] = v / v.sum(1, keepdims=True)
    tails = heads + counts - 1
    bwd[tails] = after / after.sum(1, keepdims=True)
    live = len(order)
    for k in range(1, int(counts.max())):
        while live and counts[order[live - 1]] <= k:
            live -= 1
        rows = order[:live]
        i = heads[rows] + k
        v = np.einsum("ni,nij->nj", fwd[i - 1], between[i]) * pot[i]
        fwd[i] = v / v.sum(1, keepdims=True)
        i = tails[rows] - k
        v = np.einsum("nij,nj->ni", between[i + 1], pot[i + 1] * bwd[i + 1])
        bwd[i] = v / v.sum(1, keepdims=True)
    m = fwd * bwd
    return at, m[:, 1] / m.sum(1)


def row_scores(model: Model, at: np.ndarray, p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 - prod(1 - p) over a row's tokens, put through the fitted logistic."""
    n = len(first) - 1
    row = np.searchsorted(first, at, "right") - 1
    none = np.bincount(row, np.log1p(-np.clip(p, 0, 1 - 1e-12)), n) if len(at) else np.zeros(n)
    some = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
    z = model.scale[0] * (np.log(some) - np.log1p(-some)) + model.scale[1]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sliced_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First token of each text and all features, as ``token_features`` gives them, from few texts at a time."""
    first, parts = [np.zeros(1, np.int64)], []
    for lo in range(0, len(texts), SLICE_TEXTS):
        _, _, begins, features = token_features(*utf8(pa.array(texts[lo : lo + SLICE_TEXTS], pa.large_string())))
        first.append(begins[1:] + first[-1][-1])
        parts.append(features)
    if not parts:
        return token_features(*utf8(pa.array(texts, pa.large_string())))[2:]
    out = np.empty((int(first[-1][-1]), parts[0].shape[1]), np.uint64)
    at = len(out)
    while parts:
        part = parts.pop()
        out[at - len(part) : at] = part
        at -= len(part)
    return np.concatenate(first), out


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """Fit on labelled texts; ``share`` is the share of toxic rows among all training labels."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i], toxic[i]))
    keep = [i for k, i in enumerate(order) if not k or texts[i] != texts[order[k - 1]]]
    texts, toxic = [texts[i] for i in keep], np.asarray(toxic)[keep].astype(np.int64)
    first, features = _sliced_features(texts)
    row = np.searchsorted(first, np.arange(len(features)), "right") - 1
    typical = typical_features(features, row, first, toxic) if len(features) else np.zeros(0, np.uint64)
    known = np.empty(features.shape, np.int32)
    for lo in range(0, len(features), SLICE_TOKENS):
        known[lo : lo + SLICE_TOKENS] = _known(typical, features[lo : lo + SLICE_TOKENS])
    del features  # the driver's memory is small
    labels = ((known >= 0).any(1) & (toxic[row] == 1)).astype(np.int64)
    weights, bias, trans = train_crf(known, labels, first, len(typical))
    model = Model(typical, weights, bias, trans)
    at, p = marginals(model, known, first)
    some = row_scores(model, at, p, first)
    z = np.log(some) - np.log1p(-np.clip(some, 0, 1 - 1e-9))
    # logistic regression with the labels' own share, by Newton steps with a little shrinkage
    n1 = max(1, int(toxic.sum()))
    n0 = max(1, len(toxic) - n1)
    share = min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(toxic == 1, share / n1, (1 - share) / n0) * len(toxic)
    x = np.stack([z, np.ones(len(z))], 1)
    theta = np.array([0.1, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (toxic - q)) - 1e-2 * theta
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        theta = theta + move * min(1.0, 1.0 / max(1e-9, np.abs(move).max()))
    model.scale = (max(float(theta[0]), 1e-3), float(theta[1]))
    return model


def bucket(doc_id, n: int = 5):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS) -> Model:
    """Fit on up to ``per_label`` rows of each label, the least by hash of doc_id, that are not held out.

    The sample is bounded by ``per_label`` and, for the driver's memory, by TRAIN_CHARS: longer texts are left out of
    training only. Rows with a null id or label are not used; of rows that repeat an id the larger label counts. A
    table without labels, or empty, gives a model without features, which rejects nothing.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    named = named.where(bucket(F.col("doc_id")) != 0)
    share = named.agg(F.avg("toxic")).first()[0]
    picked = None
    for value in (0, 1):
        part = named.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .where(F.length("text") <= TRAIN_CHARS)
        .join(F.broadcast(picked), "doc_id")  # at most 2 * per_label ids
        .select("text", "toxic")
        .toPandas()
    )
    texts, toxic = list(rows["text"]), rows["toxic"].to_numpy()
    del rows
    model = fit(texts, toxic, share or 0.0)
    del texts, toxic
    tidy()  # the driver goes on with other work
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Each row's ``doc_id, score, predicted, spans``; spans are byte offsets of tokens more likely toxic than not.

    Whole texts are scored, a null or empty one too; repeated ids are scored row by row.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part, buf, offsets in text_batches(batches, "text"):
            s, e, first, features = token_features(buf, offsets)
            at, p = marginals(model, _known(model.features, features), first)
            scores = row_scores(model, at, p, first)
            bad = at[p >= 0.5]
            row = np.searchsorted(first, bad, "right") - 1
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)),
                pa.StructArray.from_arrays(
                    [pa.array((x[bad] - offsets[row]).astype(np.int64)) for x in (s, e)] + [pa.array(p[p >= 0.5])],
                    ["start", "end", "p"],
                ),
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), spans],
                ["doc_id", "score", "predicted", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<start:long,end:long,p:double>>")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns as they are, without a shuffle."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part, buf, offsets in text_batches(batches, "text"):
            _, _, first, features = token_features(buf, offsets)
            at, p = marginals(model, _known(model.features, features), first)
            yield part.filter(pa.array(row_scores(model, at, p, first) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's toxicity, with spans, by a model that has not seen held-out labels. A null id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(bucket(F.col("doc_id")) == 0, F.lit(False))
    return score(docs, train(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted", "spans")
