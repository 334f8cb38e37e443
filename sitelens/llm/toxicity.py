"""Toxic spans by a linear-chain conditional random field over tokens.

Labels are on documents, so tokens are labelled from them first: features (word, prefixes, suffixes) that stand in toxic
training documents far more often than in clean ones mark the tokens of toxic documents. The chain then learns a weight
for each such feature and for each transition. Forward and backward passes give every token of a text its marginal
probability; a small logistic model over their sum, maximum and density gives the document's score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from math import exp, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE, annotate, cut, discard, runs

#: Default bounds of the training sample: toxic rows, clean rows, and bytes of one training text. Scoring reads every text whole.
MAX_TOXIC, MAX_CLEAN, MAX_TRAIN_BYTES = 1000, 3000, 64 << 10
#: Default bound of the rows of either class from which the chain's weights are learnt; which features tell, and the
#: documents' score, are learnt from the whole sample.
CHAIN_ROWS = 400
#: A feature marks tokens if its G statistic and its odds ratio reach these.
MIN_G, MIN_ODDS = 20.0, 8.0
STEPS, RATE, DECAY = 30, 0.4, 1e-3
LIMIT = 15.0

RESULT = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("expected", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "last_word", "start", "end")]))),
    ]
)


def features(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    return [f"={w}", *[f"<{w[:k]}" for k in range(3, min(len(w), 7))], *[f">{w[-k:]}" for k in range(4, min(len(w), 6))]]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -LIMIT
    #: a00, a01, a10, a11 as factors, and the start's factor of state 1
    chain: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0, 1.0)
    #: of 1 and the columns of summary()
    logit: tuple[float, ...] = (-5.0, 0.0, 0.0, 0.0)


class _Emissions(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > 200_000:
            self.clear()
        get = self.model.weights.get
        v = self.model.bias + sum(get(f, 0.0) for f in features(word))
        self[word] = v = max(-LIMIT, min(LIMIT, v))
        return v


def ratio_scan(e, start, chain):
    """Forward messages as ratios r[t] = e[t] * (a01 + a11 * r[t-1]) / (a00 + a10 * r[t-1]), anew from e[t] * s at each start.

    Each step is a 2 x 2 matrix. Tokens are cut into equal blocks that advance in lockstep: first each block's product,
    then the message at every block's begin, then all messages.
    """
    import numpy as np

    n = len(e)
    width = max(1, int(n**0.5 / 4))
    blocks = -(-n // width)
    a00, a01, a10, a11, s = chain

    def laid(v, fill):
        x = np.full(blocks * width, fill)
        x[:n] = v
        return np.ascontiguousarray(x.reshape(blocks, width).T)

    top = laid(np.where(start, 0.0, e * a11), 0.0)
    add = laid(np.where(start, e * s, e * a01), 1.0)
    mul = laid(np.where(start, 0.0, a10), 0.0)
    one = laid(np.where(start, 1.0, a00), 1.0)
    p, q, u, v = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(width):
        p, q, u, v = top[t] * p + add[t] * u, top[t] * q + add[t] * v, mul[t] * p + one[t] * u, mul[t] * q + one[t] * v
        if t % 8 == 7:
            m = np.maximum(np.maximum(p, q), np.maximum(u, v))
            p, q, u, v = p / m, q / m, u / m, v / m
    r, begin = 1.0, np.empty(blocks)
    for b, (w, x, y, z) in enumerate(zip(p.tolist(), q.tolist(), u.tolist(), v.tolist(), strict=True)):
        begin[b] = r
        r = (w * r + x) / (y * r + z)
    out = np.empty((width, blocks))
    r = begin
    for t in range(width):
        r = (top[t] * r + add[t]) / (mul[t] * r + one[t])
        out[t] = r
    return out.T.reshape(-1)[:n]


def marginals(phi, first, chain):
    """(p, r, c): the marginal of state 1 for each token, forward ratios, and backward ratios times e. first: index of each text's first token."""
    import numpy as np

    e = np.exp(phi)
    start = np.zeros(len(phi), bool)
    start[first] = True
    r = ratio_scan(e, start, chain)
    a00, a01, a10, a11, _ = chain
    end = np.roll(start, -1)
    c = ratio_scan(e[::-1], end[::-1], (a00, a10, a01, a11, 1.0))[::-1]
    x = r * c / e
    return x / (1 + x), r, c


def summary(p, bounds):
    """Rows (1, largest marginal, log(1 + sum), log(1 + sum per 1000 tokens)) of the texts whose tokens are p[bounds[i]:bounds[i+1]]."""
    import numpy as np

    out = np.zeros((len(bounds) - 1, 4))
    out[:, 0] = 1
    n = np.diff(bounds)
    full = np.flatnonzero(n > 0)
    if len(full):
        at = np.asarray(bounds)[full]
        total = np.add.reduceat(p, at)
        out[full, 1], out[full, 2], out[full, 3] = np.maximum.reduceat(p, at), np.log1p(total), np.log1p(1000 * total / n[full])
    return out


class Tagger:
    def __init__(self, model: Model):
        self.model, self.emit = model, _Emissions(model)

    def summaries(self, texts: Sequence[bytes | None]):
        """(summary rows, marginals of all tokens, bounds of the texts in them)."""
        import numpy as np

        emit, phi, bounds = self.emit, [], [0]
        for t in texts:
            phi += [emit[w] for w in (t or b"").translate(ALNUM_TABLE).split()]
            bounds.append(len(phi))
        bounds, p = np.array(bounds), np.zeros(0)
        if len(phi):
            p = marginals(np.array(phi), np.unique(bounds[:-1][np.diff(bounds) > 0]), self.model.chain)[0]
        return summary(p, bounds), p, bounds

    def __call__(self, texts: Sequence[bytes | None]) -> list[tuple]:
        import numpy as np

        x, p, bounds = self.summaries(texts)
        score = 1 / (1 + np.exp(-np.clip(x @ np.array(self.model.logit), -30, 30)))
        hot = p >= 0.5
        out = []
        for i, t in enumerate(texts):
            a, b = bounds[i], bounds[i + 1]
            mark = hot[a:b]
            found = runs(t, bytearray(mark.tobytes())) if mark.any() else []
            out.append((float(score[i]), int(b - a), float(np.expm1(x[i, 2])), found))
        return out


def _distinct(rows: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """Without near copies, which would make all their words look alike in label."""
    from .near_dedup import Sketcher, WordHasher, shingle_set

    hasher = WordHasher()
    sets = [(shingle_set(text, 3, hasher)[0], text, y) for text, y in rows]
    sets = [x for x in sets if len(x[0])]
    seen, out = set(), []
    for (keys, _), (_, text, y) in zip(Sketcher(16, 4)([s for s, _, _ in sets]), sets, strict=True):
        if seen.isdisjoint(keys):
            out.append((text, y))
        seen.update(keys)
    return out


def fit(rows: list[tuple[bytes, int]], share: float | None = None, chain_rows: int = CHAIN_ROWS) -> Model:
    """A model from (text, label) rows. share: of toxic rows in the corpus, to which scores are calibrated. Without both
    labels: scores near the one there is. The chain learns from the first ``chain_rows`` rows of either label."""
    import numpy as np

    rows = _distinct(rows)
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    if not n1 or not n0:
        return Model(logit=(5.0 if n1 else -5.0, 0.0, 0.0, 0.0))
    # texts are split anew in each pass and what is remembered of words is bounded, to keep the driver small
    words_of = lambda t: t.translate(ALNUM_TABLE).split()
    df = {0: Counter(), 1: Counter()}
    memo: dict[bytes, list[str]] = {}
    # clean rows need only the features that some toxic rows have
    for side in (1, 0):
        memo.clear()
        for text, y in rows:
            if y == side:
                own = set()
                for w in set(words_of(text)):
                    if (fs := memo.get(w)) is None:
                        if len(memo) > 30_000:
                            memo.clear()
                        fs = memo[w] = features(w) if side else [f for f in features(w) if f in df[1]]
                    own.update(fs)
                df[side].update(own)
        if side:
            df[1] = Counter({f: n for f, n in df[1].items() if n >= 3})
    telling = set()
    for f, a in df[1].items():
        b = df[0][f]
        odds = (a + 0.5) / (n1 - a + 0.5) * (n0 - b + 0.5) / (b + 0.5)
        if odds >= MIN_ODDS:
            ea, eb = (a + b) * n1 / (n0 + n1), (a + b) * n0 / (n0 + n1)
            if 2 * (a * log(a / ea) + (b * log(b / eb) if b else 0)) >= MIN_G:
                telling.add(f)
    index = {f: i for i, f in enumerate(sorted(telling))}
    df.clear()
    memo.clear()
    train = [[(text, y) for text, y in rows if y == side and words_of(text)][:chain_rows] for side in (0, 1)]
    token_of, feat_of, label, bounds = [], [], [], [0]
    own: dict[bytes, list[int]] = {}  # of a word: its telling features
    for text, y in train[0] + train[1]:
        for w in words_of(text):
            if (ids := own.get(w)) is None:
                ids = own[w] = [index[f] for f in features(w) if f in index]
            if ids:
                token_of += [len(label)] * len(ids)
                feat_of += ids
            label.append(1 if y and ids else 0)
        bounds.append(len(label))
    token_of, feat_of = np.array(token_of, np.int64), np.array(feat_of, np.int64)
    label, bounds = np.array(label, float), np.array(bounds)
    first = bounds[:-1]
    inner = np.ones(len(label), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    pairs = np.array([((label[inner - 1] == i) & (label[inner] == j)).sum() for i in (0, 1) for j in (0, 1)], float)
    # weights, bias, log a01, log a10, log a11, log s; a00 is 1
    k = len(index)
    theta = np.zeros(k + 5)
    theta[k] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        phi = theta[k] + np.bincount(token_of, theta[feat_of], len(label)) if k else np.full(len(label), theta[k])
        chain = (1.0, *np.exp(theta[k + 1 : k + 5]))
        p, r, c = marginals(np.clip(phi, -LIMIT, LIMIT), first, chain)
        miss = label - p
        g = np.zeros_like(theta)
        if k:
            g[:k] = np.bincount(feat_of, miss[token_of], k)
        g[k] = miss.sum()
        before, here = r[inner - 1], c[inner]
        w01, w10, w11 = chain[1] * here, before, before * chain[3] * here
        w10 = before * chain[2]
        total = 1 + w01 + w10 + w11
        g[k + 1 : k + 4] = pairs[1:] - [(w / total).sum() for w in (w01, w10, w11)]
        g[k + 4] = miss[first].sum()
        g = g / max(1.0, label.sum()) - DECAY * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[k + 1 :] = np.clip(theta[k + 1 :], -6, 6)
    model = Model({f: float(theta[i]) for f, i in index.items()}, float(theta[k]), (1.0, *map(float, np.exp(theta[k + 1 : k + 5]))))
    # documents: weighted logistic regression over all rows
    tagger, parts = Tagger(model), []
    for i in range(0, len(rows), 100):
        parts.append(tagger.summaries([t for t, _ in rows[i : i + 100]])[0])
    x, y = np.concatenate(parts), np.array([y for _, y in rows], float)
    share = n1 / (n0 + n1) if share is None else min(max(share, 0.01), 0.99)
    weight = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    model.logit = tuple(map(float, _logistic(x, y, weight)))
    return model


def _logistic(x, y, weight):
    """Weighted ridge regression by Newton steps, halved until the loss falls."""
    import numpy as np

    ridge = np.array([0.01, 0.1, 0.1, 0.1])
    loss = lambda b: (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ b))).sum() + (ridge * b * b).sum() / 2
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (q - y)) + ridge * beta
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(ridge), grad)
        size, now = 1.0, loss(beta)
        while size > 1e-6 and loss(beta - size * step) > now:
            size /= 2
        beta = beta - size * step
        if abs(size * step).max() < 1e-9:
            break
    return beta


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_toxic: int, max_clean: int, max_bytes: int
) -> tuple[list[tuple[bytes, int]], float | None]:
    """(rows, share of toxic labels among all). At most ``max_toxic`` and ``max_clean`` labelled ids, those whose hashes
    come first; of their rows, whose ids may repeat, as many again at most, none over ``max_bytes`` long."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("wanted")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    count = dict(marked.groupBy("y").count().collect())
    if not count:
        return [], None
    order = (F.xxhash64("wanted"), F.col("wanted"))
    most = {1: max_toxic, 0: max_clean}
    first = lambda y: marked.where(F.col("y") == y).orderBy(*order).limit(most[y])
    both = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(first(1).union(first(0))), F.col("id") == F.col("wanted"))
    both = cut(both.where(F.octet_length("text") <= max_bytes).select("id", "text", "y"), "labelled")
    rows = []
    for y in (0, 1):
        chosen = both.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "text").limit(most[y])
        rows += sorted((r.id, r.text, r.y) for r in chosen.collect())
    discard(both)
    return [(text.encode(), y) for _, text, y in sorted(rows)], count.get(1, 0) / sum(count.values())


def score_toxicity(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    out: str = "toxicity",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with the struct ``out``: score (0 to 1), n_tokens, expected (sum of the marginals), spans (runs of tokens
    whose marginal reaches 0.5, with code-point offsets [start, end)).

    Only the text enters a score. Null, empty and blank texts have no tokens and get the score of a text without evidence;
    texts are read whole; repeated rows get equal scores; an empty table gives an empty one. A column called ``out`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, lambda: Tagger(held.value), RESULT, out, text_col, carry)


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_toxic: int = MAX_TOXIC,
    max_clean: int = MAX_CLEAN,
    max_bytes: int = MAX_TRAIN_BYTES,
    chain_rows: int = CHAIN_ROWS,
) -> Model:
    """A model from labelled documents; ``labels`` holds only the rows it may learn from.

    It learns from a bounded sample: at most ``max_toxic`` and ``max_clean`` rows, those whose ids' hashes come first, of
    texts of at most ``max_bytes``, the chain's weights from ``chain_rows`` of either label. The bounds hold for rows that
    repeat an id too. Rows without id, text or label are left out; of several labels for an id the highest holds. Without
    labels, or without rows for them, every score is near 0. Other columns are not read.
    """
    return fit(*training_rows(docs, labels, id_col, text_col, label_col, max_toxic, max_clean, max_bytes), chain_rows=chain_rows)
