"""Language identification by a linear-chain CRF over words.

Every word gets a language label. Emissions add up hashed weights of the word's
byte n-grams with its blanks (so the outer ones are prefixes and suffixes) and
of lexicon entries; transitions are learned from training windows half of which
switch language. Forward-backward gives each word's label marginals; a
document's language has the largest sum of marginals over all its words, and its
score is the mean marginal of that language. ``identify`` also counts the words of
each language, ``label_words`` gives the stretches of code-switched text.

Chains are windows of ``WINDOW`` words, which bounds memory for any text. Each is
decoded with ``CONTEXT`` words of its neighbours on both sides, whose marginals are
not used, so that the learned transitions act across windows.
The model has about 0.8 MB a language, and ``MOST_LANGUAGES`` languages at most.
Training uses at most ``TRAIN_DOCS`` documents of each language, a stretch of at
most ``TRAIN_CHARS`` characters of each, and ``TRAIN_WINDOWS`` windows of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from .common import Sent, WordHasher, _byte_table, joined, text_groups
from .crf import forward_backward

WINDOW = 32
CONTEXT = 4
TRAIN_DOCS = 200
TRAIN_CHARS = 20_000
TRAIN_WINDOWS = 1_500
MIN_SCORE = 0.35
#: Values of ``lang`` that are learned: the most frequent ones.
MOST_LANGUAGES = 400
UNKNOWN = "und"

_ORDERS, _BITS, _LEXICON = (2, 3, 4), 16, 300
#: Letters only: ASCII letters in lower case and all bytes from 0x80 on.
LETTERS = _byte_table(lambda b: b >= 0x80 or 0x61 <= b <= 0x7A)


class Model:
    """Weights of a trained language CRF; ``languages`` in code-point order."""

    def __init__(self, languages: list[str]) -> None:
        n = len(languages)
        self.languages = languages
        self.grams = np.zeros((len(_ORDERS), 1 << _BITS, n), dtype=np.float32)
        self.lexicon, self.words = np.empty(0, dtype=np.uint64), np.zeros((0, n), dtype=np.float32)
        self.trans, self.start = np.zeros((n, n)), np.zeros(n)

    def emissions(self, buf: bytes, starts, ends, hashes) -> np.ndarray:
        """Log scores (words, languages) of the words of a padded buffer."""
        out = np.zeros((len(starts), len(self.languages)))
        arr = np.frombuffer(buf, dtype=np.uint8)
        step, low = max(1, (1 << 20) // max(1, len(self.languages))), 0
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + step)))
            a, b = int(starts[low]) - 1, int(ends[high - 1]) + 1
            piece = arr[a:b].astype(np.uint32)
            s, e = starts[low:high] - 1 - a, ends[low:high] + 1 - a
            for k, order in enumerate(_ORDERS):
                index = _gram_index(piece, order)
                if not len(index):
                    continue
                total = np.zeros((len(index) + 1, out.shape[1]))
                np.cumsum(self.grams[k][index], axis=0, dtype=np.float64, out=total[1:])
                last = e - order + 1
                on = last > s
                out[low:high][on] += total[last[on]] - total[s[on]]
            low = high
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            known = self.lexicon[at] == hashes
            out[known] += self.words[at[known]]
        return out

    def marginals(self, buf: bytes, starts, ends, hashes, bounds) -> np.ndarray:
        """Label marginals (words, languages); document k has the words ``bounds[k]`` to ``bounds[k + 1]``."""
        counts = -(-np.diff(bounds) // WINDOW)
        doc = np.repeat(np.arange(len(counts)), counts)
        first = bounds[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
        low, high = np.maximum(bounds[doc], first - CONTEXT), np.minimum(bounds[doc + 1], first + WINDOW + CONTEXT)
        last = np.minimum(bounds[doc + 1], first + WINDOW)
        out = np.zeros((len(starts), len(self.languages)), dtype=np.float32)
        # Whole documents need not fit one batch of windows: cut by windows, not by documents.
        for w in range(0, len(doc), 4_096):
            own = slice(w, w + 4_096)
            a, b = int(low[own][0]), int(high[own][-1])
            scores = self.emissions(buf, starts[a:b], ends[a:b], hashes[a:b])
            at = low[own, None] + np.arange(WINDOW + 2 * CONTEXT)
            valid = at < high[own, None]
            marginal = forward_backward(scores[np.minimum(at, b - 1) - a], self.trans, self.start, valid)
            core = (at >= first[own, None]) & (at < last[own, None])
            out[at[core]] = marginal[core]
        return out

    def _words(self, texts: list[bytes], hasher: WordHasher):
        """The words of texts: places in one buffer, document bounds, where each text begins, marginals."""
        buf, offsets = joined([b" " + t for t in texts], LETTERS)
        buf += b" "
        starts, ends, hashes = hasher(buf)
        bounds = np.append(np.searchsorted(starts, offsets), len(starts)).astype(np.int64)
        return starts, ends, bounds, offsets + 1, self.marginals(buf, starts, ends, hashes, bounds)

    def predict(self, texts: list[bytes], hasher: WordHasher) -> list[tuple[str, float, list[int]]]:
        """(language, score, words of each language) of each text."""
        if not self.languages:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        _, _, bounds, _, marginal = self._words(texts, hasher)
        label, out = marginal.argmax(axis=1), []
        for text, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b or not _has_letter(text):
                out.append((UNKNOWN, 0.0, []))
            else:
                total = marginal[a:b].sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                counts = np.bincount(label[a:b], minlength=len(self.languages)).tolist()
                out.append((self.languages[best], min(1.0, float(total[best] / (b - a))), counts))
        return out

    def stretches(self, texts: list[bytes], hasher: WordHasher) -> list[list[tuple[int, int, str]]]:
        """Per text: (start, end, language) of runs of words with the same most likely label, in code points."""
        if not self.languages:
            return [[] for _ in texts]
        starts, ends, bounds, offsets, marginal = self._words(texts, hasher)
        label, out = marginal.argmax(axis=1), []
        for text, at, a, b in zip(texts, offsets.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b or not _has_letter(text):
                out.append([])
                continue
            # Bytes that begin a code point, up to each place.
            points = np.append(0, np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))
            edge = np.append(np.flatnonzero(np.append(True, label[a + 1 : b] != label[a : b - 1])), b - a) + a
            out.append([(int(points[starts[x] - at]), int(points[ends[y - 1] - at]), self.languages[label[x]]) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())])
        return out


def _has_letter(text: bytes) -> bool:
    if any(map(str.isalpha, text[:200].decode("ascii", "ignore"))):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "ignore")))


def _gram_index(piece: np.ndarray, order: int) -> np.ndarray:
    n = len(piece) - order + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    code = np.zeros(n, dtype=np.uint32)
    for i in range(order):
        code = code * np.uint32(0x01000193) + piece[i : i + n]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)


def train(rows: list[tuple[str, str]], *, epochs: int = 6, seed: int = 1) -> Model:
    """Fit a model to (language, text) rows.

    Weights begin at damped log ratios of feature counts and are then fitted by
    AdaGrad on the conditional likelihood of the label sequences.
    """
    languages = sorted({lang for lang, _ in rows})
    model, hasher, rng = Model(languages), WordHasher(), np.random.default_rng(seed)
    n = len(languages)
    if n == 0:
        return model
    windows: list[list] = [[] for _ in languages]  # (n-gram ids of the buffer, starts, ends, hashes)
    words = [{} for _ in languages]
    for lang, text in rows:
        y = languages.index(lang)
        buf, _ = joined([b" " + text.encode()], LETTERS)
        buf += b" "
        starts, ends, hashes = hasher(buf)
        piece = np.frombuffer(buf, dtype=np.uint8).astype(np.uint32)
        ids = [_gram_index(piece, order).astype(np.int64) + (k << _BITS) for k, order in enumerate(_ORDERS)]
        windows[y] += [(ids, starts[i : i + WINDOW], ends[i : i + WINDOW], hashes[i : i + WINDOW]) for i in range(0, len(starts), WINDOW)]
        for h, c in zip(*(x.tolist() for x in np.unique(hashes, return_counts=True))):
            words[y][h] = words[y].get(h, 0) + c
    windows = [w if len(w) <= TRAIN_WINDOWS else [w[i] for i in rng.choice(len(w), TRAIN_WINDOWS, replace=False)] for w in windows]
    total = [max(1, sum(w.values())) for w in words]
    lexicon = sorted({h for w in words for h, _ in sorted(w.items(), key=lambda x: (-x[1], x[0]))[:_LEXICON]})
    model.lexicon = np.array(lexicon, dtype=np.uint64)
    base, place = len(_ORDERS) << _BITS, {h: i for i, h in enumerate(lexicon)}

    def sequence(y, ids, starts, ends, hashes):
        """(feature ids, label) of each word of a window."""
        out = []
        for s, e, h in zip((starts - 1).tolist(), (ends + 1).tolist(), hashes.tolist()):
            own = [x[s : e - order + 1] for x, order in zip(ids, _ORDERS) if e - order + 1 > s]
            if h in place:
                own.append([base + place[h]])
            out.append((np.concatenate(own), y))
        return out

    pool = [sequence(y, *w) for y, own in enumerate(windows) for w in own]
    grams = np.full((base + len(lexicon), n), 0.05)
    for y in range(n):
        own = [f for window in pool for f, label in window if label == y]
        if own:
            grams[:, y] += np.bincount(np.concatenate(own), minlength=len(grams))
    share = np.array([[(w.get(h, 0) + 0.5) / t for w, t in zip(words, total)] for h in lexicon]) if lexicon else np.zeros((0, n))
    seen = (grams > 0.06).any(axis=1)
    counts = grams[:base].reshape(len(_ORDERS), -1, n)
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).reshape(-1, n)
    weights = np.concatenate([0.3 * (logs - logs.mean(axis=1, keepdims=True)), 0.3 * (np.log(share) - np.log(share).mean(axis=1, keepdims=True))])
    weights[:base][~seen[:base]] = 0

    trans, start = np.full((n, n), -3.0) + 3.0 * np.eye(n), np.zeros(n)
    step_w, step_t, step_s = np.full(weights.shape, 1e-2), np.full((n, n), 1e-2), np.full(n, 1e-2)
    for _ in range(epochs if n > 1 and pool else 0):
        order = rng.permutation(len(pool))
        sequences = []
        for i in order:
            own = pool[i]
            if rng.random() < 0.5:  # a window that switches language
                other = pool[rng.integers(len(pool))]
                k = int(rng.integers(1, WINDOW))
                own = (own[:k] + other)[:WINDOW]
            if own:
                sequences.append(own)
        for low in range(0, len(sequences), 256):
            batch = sequences[low : low + 256]
            m, longest = len(batch), max(map(len, batch))
            sizes = np.array([len(f) for s in batch for f, _ in s])
            flat = np.concatenate([f for s in batch for f, _ in s])
            gold = np.array([y for s in batch for _, y in s])
            valid = np.arange(longest)[None] < np.array([len(s) for s in batch])[:, None]
            edge = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            emit = np.zeros((m, longest, n))
            emit[valid] = np.add.reduceat(weights[flat], edge, axis=0)
            marginal, expected = forward_backward(emit, trans, start, valid, pairs=True)
            error = marginal[valid]
            error[np.arange(len(gold)), gold] -= 1
            per = np.repeat(error, sizes, axis=0)
            for y in range(n):
                grad = np.bincount(flat, weights=per[:, y], minlength=len(weights)) / m
                step_w[:, y] += grad**2
                weights[:, y] -= 0.1 * grad / np.sqrt(step_w[:, y])
            labels = np.full((m, longest), -1)
            labels[valid] = gold
            both = (labels[:, 1:] >= 0) & (labels[:, :-1] >= 0)
            seen_t = np.zeros((n, n))
            np.add.at(seen_t, (labels[:, :-1][both], labels[:, 1:][both]), 1)
            grad = (expected - seen_t) / m
            step_t += grad**2
            trans -= 0.1 * grad / np.sqrt(step_t)
            grad = (marginal[:, 0].sum(axis=0) - np.bincount(labels[:, 0], minlength=n)) / m
            step_s += grad**2
            start -= 0.1 * grad / np.sqrt(step_s)
    model.grams = weights[:base].reshape(len(_ORDERS), 1 << _BITS, n).astype(np.float32)
    model.words, model.trans, model.start = weights[base:].astype(np.float32), trans, start
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, *, per_language: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> tuple[DataFrame | None, int]:
    """Rows (lang, text, hash) among which are the training texts, and how many each
    language may have; no rows if nothing is labelled."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("_h", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).toLocalIterator()}
    if not counts:
        return None, 0
    most = max(1, min(per_language, 40 * per_language // len(counts)))
    limit = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(int(2 * most / n * (1 << 20)) + 1))])
    begin = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.greatest(F.lit(1), F.length("text") - chars + 1)).cast("int") + 1
    return labelled.filter(F.col("_h") < limit[F.col("lang")]).select("lang", F.substring(F.col("text"), begin, F.lit(chars)).alias("text"), "_h"), most


def _chosen(rows, most: int) -> list[tuple[str, str]]:
    """The ``most`` rows (lang, text, hash) of least hash of each language."""
    out: dict[str, list] = {}
    for lang, text, h in rows:
        own = out.setdefault(lang, [])
        own.append((h, text))
        if len(own) > 4 * most:  # repeated ids share a hash
            own.sort()
            del own[most:]
    return [(lang, text) for lang in sorted(out) for _, text in sorted(out[lang])[:most]]


def training_rows(docs: DataFrame, **options) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled, not held-out texts of each language.

    Chosen by hash of the id; more than 40 languages share 40 times the bound.
    """
    some, most = _sample(docs, **options)
    return [] if some is None else _chosen(some.toLocalIterator(), most)


def _trainer(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train(_chosen((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), most))
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(vars(model))], pa.binary())], ["model"])

    return run


def fit(docs: DataFrame, **options) -> Model:
    """Train on a bounded sample of ``docs``, in a task, so that the driver holds the
    model only."""
    some, most = _sample(docs, **options)
    row = None if some is None else some.repartition(1).mapInArrow(_trainer(most), "model binary").first()
    model = train([])
    vars(model).update({} if row is None else cloudpickle.loads(row[0]))
    return model


IDENTIFIED = "doc_id bigint, held_out boolean, lang_pred string, score double, lang_words string"


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, texts in text_groups(batch.column(2), 1 << 19):
                langs, scores, counts = zip(*model.value.predict(texts, hasher))
                words = [",".join(f"{lang}:{n}" for lang, n in zip(model.value.languages, own) if n) for own in counts]
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(words, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "lang_words"])

    return run


LABELLED = "doc_id bigint, spans array<struct<s:bigint,e:bigint,lang:string>>"


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """Stretches of one language in each text: ``doc_id``, ``spans`` (code points, end exclusive).

    Runs of neighbouring words whose most likely label is the same; one row per
    input row. Null, empty and letterless texts have none, nor has any under a model
    without languages; an empty table gives no rows. Other columns are ignored.
    """
    sent, kind = Sent(docs.sparkSession, model), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, texts in text_groups(batch.column(1), 1 << 19):
                found = [[{"s": s, "e": e, "lang": lang} for s, e, lang in own] for own in sent.value.stretches(texts, hasher)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, LABELLED)


def _keeper(model, at: int, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, texts in text_groups(batch.column(at), 1 << 19):
                keep = [lang != UNKNOWN and score >= min_score for lang, score, _ in model.value.predict(texts, hasher)]
                yield batch.slice(first, len(texts)).filter(pa.array(keep))

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``lang_words``.

    ``lang_words`` lists the words whose most likely label is a language (``de:3,en:40``).

    Null, empty or letterless text is ``und`` with score 0, as is every text
    under a model without languages. Only the text enters a prediction; equal
    texts get equal results; ties go to the first language in code-point order;
    an empty table gives no rows. Other columns are ignored.
    """
    sent = Sent(docs.sparkSession, model)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_predictor(sent), IDENTIFIED)


def drop_unidentified(docs: DataFrame, model: Model, *, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without rows of no language or a score below ``min_score``; all columns stay.

    Null, empty and letterless texts go; repeated rows go or stay alike; an empty
    table gives no rows.
    """
    sent = Sent(docs.sparkSession, model)
    return docs.mapInArrow(_keeper(sent, docs.columns.index("text"), min_score), docs.schema)
