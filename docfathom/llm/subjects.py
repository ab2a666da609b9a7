"""Subject areas of documents by subject-specific n-gram language models (problem 9)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfathom.session import spread, written

from .leakage import plain_text

#: Weights of the bigram, the unigram and the smoothing model.
WEIGHTS = (0.5, 0.35, 0.15)
LEAST_SHARE = 1 / 3

_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")
_UNIT = re.compile(r"[^\W\d_]+(?:_[^\W_]+)+|[㐀-䶿一-鿿]|[^\W\d_㐀-䶿一-鿿]+|\d+")
# The same for texts without 。！？, for lower-case ASCII sentences and for sentences without "_", in less time.
_PLAIN_SENTENCE = re.compile(r"\s(?:(?<=[.!?]\s)\s*|(?<=\n)\n*)")
_ASCII_UNIT = re.compile(r"[a-z]+(?:_[a-z0-9]+)*|[0-9]+")
_PLAIN_UNIT = re.compile(r"[㐀-䶿一-鿿]|[^\W\d_㐀-䶿一-鿿]+|\d+")
_CJK_STOP = re.compile("[。！？]")


class _Shapes(dict):
    def __missing__(self, u: str) -> str:
        shape = self[u] = "0" if u[0].isdigit() else "_" if "_" in u else u
        return shape


def sentences_of(text: str, shapes: _Shapes | None = None) -> list[list[str]]:
    """Units of each sentence: words, single CJK characters; numbers and identifiers by kind. Sentences of no unit are none.

    ``shapes`` keeps what units count as over the texts of a batch.
    """
    shape = (_Shapes() if shapes is None else shapes).__getitem__
    plain = plain_text(text)
    sentences = (_PLAIN_SENTENCE if plain.isascii() or not _CJK_STOP.search(plain) else _SENTENCE).split(plain)
    split = (list(map(shape, (_ASCII_UNIT if x.isascii() else _UNIT if "_" in x else _PLAIN_UNIT).findall(x))) for x in sentences)
    return [units for units in split if units]


#: Frequent German and English function words; sentences are modelled by language, as subjects differ in their mix.
GERMAN = frozenset("der die das den dem des und oder für mit am im auf zu zur zum ist sind nicht ein eine einen wer wie wird werden bitte nach vor von bei über auch muss diese dieser gilt".split())
ENGLISH = frozenset("the a an of and or for with at in on to is are was were not who how that this it be by from after before again each when while as has have".split())


LANGUAGES = ("de", "en", "zh")


class _Kinds(dict):
    def __missing__(self, u: str) -> int:
        kind = self[u] = 2 if "㐀" <= u[0] <= "鿿" else 0 if u in GERMAN else 1 if u in ENGLISH else 3
        return kind


def languages_of(sentences: list[list[str]]) -> np.ndarray:
    """Places in LANGUAGES: Chinese with a third of its characters, German with more of its function words than English ones, else English."""
    if not sentences:
        return np.zeros(0, np.int64)
    lengths = np.array([len(x) for x in sentences], np.int64)
    kind = np.fromiter(map(_Kinds().__getitem__, chain.from_iterable(sentences)), np.int64, int(lengths.sum()))
    de, en, zh = (np.add.reduceat((kind == k).astype(np.int64), np.cumsum(lengths) - lengths) for k in range(3))
    return np.where(zh * 3 >= lengths, 2, np.where(de > en, 0, 1))


class _Numbers(dict):
    def __missing__(self, u: str) -> int:
        return 0


class LanguageModels:
    """Interpolated bigram models of the subjects in one language, against one of all its text.

    p_s(u | v) = w2 c_s(v, u) / c_s(v) + w1 c_s(u) / N_s + w0 p(u | v), with p the same interpolation over all text. Counts
    are moved towards their expectation by their square root, so that what may be chance tells nothing. ``gain`` holds
    log p_s - log p by subject, of each bigram seen twice and of each unit for other bigrams: summed over a sentence and
    divided by its length, the background's per-token cross-entropy less the subject's.
    """

    def __init__(self, n_subjects: int) -> None:
        self.number = _Numbers({"": 1})
        self.pairs, self.pair_rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.gain = np.zeros((2, n_subjects), np.float32)

    def rows_of(self, sentences: list[list[str]], starts: np.ndarray) -> np.ndarray:
        """The row of gains of each token: that of its bigram, else of its unit, else 0."""
        return self.rows_at(np.fromiter(map(self.number.__getitem__, chain.from_iterable(sentences)), np.int64), starts)[1]

    def rows_at(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the unit before each of these, and their rows of gains."""
        before = np.roll(ids, 1)
        before[starts] = self.number[""]
        keys = before * (len(self.number) + 1) + ids
        if not len(self.pairs):
            return before, ids
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return before, np.where((self.pairs[at] == keys) & (ids > 0) & (before > 0), self.pair_rows[at], ids)

    def per_token(self, sentences: list[list[str]]) -> np.ndarray:
        """Gain per token of each sentence by subject."""
        lengths = np.array([len(x) for x in sentences], np.int64)
        starts = np.cumsum(lengths) - lengths
        return np.add.reduceat(self.gain[self.rows_of(sentences, starts)], starts, axis=0) / lengths[:, None].astype(np.float32)


def _towards(counts: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Counts moved by their square root towards what is expected, at most up to it."""
    root = np.sqrt(counts)
    return np.where(counts > expected, np.maximum(counts - root, expected), np.minimum(counts + root + 0.5, expected))


class SubjectModels:
    """Models of all languages, with the gain from which on a sentence is taken to be about a subject."""

    def __init__(self, subjects: list[str]) -> None:
        self.subjects = subjects
        self.languages: dict[str, LanguageModels] = {}
        self.accept = np.full(len(subjects), 0.06, np.float32)

    def subjects_in(self, sentences: list[list[str]]) -> np.ndarray:
        """The number of each sentence's subject: that of the lowest cross-entropy if it is lower than the background's by the subject's threshold, else -1."""
        out = np.full(len(sentences), -1, np.int64)
        if not self.subjects or not sentences:
            return out
        languages = languages_of(sentences)
        for language, models in self.languages.items():
            own = np.nonzero(languages == LANGUAGES.index(language))[0]
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                gains = models.per_token([sentences[i] for i in part])
                best = gains.argmax(1)
                out[part] = np.where(gains[np.arange(len(part)), best] >= self.accept[best], best, -1)
        return out

    def shares_of(self, texts: list[str | None]) -> list[dict[int, float]]:
        """Share of each text's sentences about each subject that has any."""
        shapes = _Shapes()
        split = [sentences_of(x, shapes) if x else [] for x in texts]
        found = self.subjects_in([x for own in split for x in own]).tolist()
        out, at = [], 0
        for own in split:
            n = Counter(k for k in found[at : at + len(own)] if k >= 0)
            at += len(own)
            out.append({k: v / len(own) for k, v in n.items()})
        return out

    def shares(self, text: str | None) -> dict[int, float]:
        return self.shares_of([text])[0]


#: Parts of the labelled texts; each has models of its own, fitted on the others, that thresholds are chosen by.
HELD_OUT = 4
THRESHOLDS = (0.045, 0.06, 0.08, 0.1)
#: What a sentence counts in all for the subjects of its text: a multiple of all numbers up to 16, so that counts stay whole and their sums exact.
WHOLE = 720_720
#: Keys that a task gathers before it adds them up and hands them on.
GATHERED = 2_000_000

_UNITS = pa.schema({"part": pa.int32(), "labels": pa.list_(pa.int32()), "lengths": pa.list_(pa.int32()), "languages": pa.list_(pa.int32()), "units": pa.list_(pa.string())})
_BY_PART = [f"n{f}" for f in range(HELD_OUT)]


def _units(batches: Iterator[pa.RecordBatch], number: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Labelled texts (part, text, subjects) cut into units: length and language of each sentence, and the units of all of them."""
    for batch in batches:
        shapes = _Shapes()
        for a in range(0, batch.num_rows, 500):
            cut = batch.slice(a, 500)
            split = [sentences_of(x, shapes) if x else [] for x in cut.column(1).to_pylist()]
            labels = [sorted({number[x] for x in own or () if x in number}) for own in cut.column(2).to_pylist()]
            languages = iter(languages_of([x for own in split for x in own]).tolist())
            columns = (cut.column(0).to_pylist(), labels, [[len(x) for x in own] for own in split], [[next(languages) for _ in own] for own in split], [[u for x in own for u in x] for own in split])
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, _UNITS.types)], schema=_UNITS)


class _Texts:
    """Some texts cut into units, in arrays by text, by sentence and by unit."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        part, labels, lengths, languages, units = batch.columns
        self.part, self.labels = part.to_numpy(zero_copy_only=False).astype(np.int64), labels.to_pylist()
        self.sizes = pc.list_value_length(lengths).to_numpy(zero_copy_only=False).astype(np.int64)
        self.lengths, self.languages = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lengths, languages))
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        coded = units.flatten().dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def of_language(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the sentences in a language, where each starts among their units, and the codes of these."""
        own = np.nonzero(self.languages == k)[0]
        lengths = self.lengths[own]
        return own, np.cumsum(lengths) - lengths, self.codes[np.repeat(self.languages == k, self.lengths)]

    def named(self, n_subjects: int) -> np.ndarray:
        out = np.zeros((len(self.sizes), n_subjects), bool)
        for d, own in enumerate(self.labels):
            out[d, own] = True
        return out


def _texts(batches: Iterator[pa.RecordBatch], n_subjects: int = 1) -> Iterator[_Texts]:
    """All texts, a stretch of them at a time, so that what is held for its units and subjects does not grow with the batch."""
    most = max(20_000, 4_800_000 // max(1, n_subjects))
    for batch in batches:
        if not batch.num_rows:
            continue
        stretch = np.cumsum(pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False)) // most
        starts = np.concatenate([[0], np.nonzero(np.diff(stretch))[0] + 1, [batch.num_rows]]).tolist()
        for a, b in zip(starts, starts[1:]):
            yield _Texts(batch.slice(a, b - a))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, v, u) and its count by part of the texts: u alone, v alone as the unit before another ("" before the first), and u after v."""
    for texts in _texts(batches):
        words = pa.concat_arrays([pa.array([""], texts.words.type), texts.words])
        wide = len(words)
        for k in range(len(LANGUAGES)):
            own, starts, codes = texts.of_language(k)
            if not len(own):
                continue
            u = codes + 1
            v = np.roll(u, 1)
            v[starts] = 0
            part = np.repeat(texts.part[texts.owner[own]], texts.lengths[own])
            for key, has_v, has_u in ((u, False, True), (v, True, False), (v * wide + u, True, True)):
                distinct, at = np.unique(key, return_inverse=True)
                counts = np.bincount(at * HELD_OUT + part, minlength=len(distinct) * HELD_OUT).reshape(-1, HELD_OUT)
                first, second = np.divmod(distinct, wide) if has_v and has_u else (distinct, distinct)
                none = pa.nulls(len(distinct), words.type)
                columns = [pa.array(np.full(len(distinct), k, np.int32)), words.take(pa.array(first)) if has_v else none, words.take(pa.array(second)) if has_u else none]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[:, f]) for f in range(HELD_OUT))], names=["language", "v", "u", *_BY_PART])


class _Counted:
    """Labelled texts cut into units, as a table of the cluster or as batches here, that are read as often as there are rounds."""

    def __init__(self, labelled: DataFrame | list[tuple[str, list[str]]], subjects: list[str]) -> None:
        cut = partial(_units, number={x: k for k, x in enumerate(subjects)})
        if isinstance(labelled, DataFrame):
            texts = labelled.select(F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)).cast("int").alias("part"), "text", "subjects")
            self.units = written(spread(texts).mapInArrow(cut, "part int, labels array<int>, lengths array<int>, languages array<int>, units array<string>"))
        else:
            columns = [d % HELD_OUT for d in range(len(labelled))], [x for x, _ in labelled], [list(x) for _, x in labelled]
            kinds = pa.int32(), pa.string(), pa.list_(pa.string())
            self.units = list(cut(iter([pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=["part", "text", "subjects"])])))

    def vocabulary(self) -> pa.Table:
        """Counts of all units and of the bigrams seen twice."""
        keys, total = ["language", "v", "u"], " + ".join(_BY_PART)
        if isinstance(self.units, DataFrame):
            counts = self.units.mapInArrow(_vocabulary, f"language int, v string, u string, {', '.join(f'{n} long' for n in _BY_PART)}")
            summed = counts.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in _BY_PART))
            return summed.where(f"v is null or u is null or {total} >= 2").toArrow()
        batches = list(_vocabulary(iter(self.units)))
        if not batches:
            return pa.table({"language": pa.array([], pa.int32()), "v": pa.array([], pa.string()), "u": pa.array([], pa.string())} | {n: pa.array([], pa.int64()) for n in _BY_PART})
        summed = pa.Table.from_batches(batches).group_by(keys).aggregate([(n, "sum") for n in _BY_PART]).rename_columns({f"{n}_sum": n for n in _BY_PART})
        seen = sum(summed[n].to_numpy() for n in _BY_PART) >= 2
        return summed.filter(pc.or_(pc.or_(pc.is_null(summed["v"]), pc.is_null(summed["u"])), pa.array(seen)))

    def sums(self, count: partial) -> tuple[np.ndarray, np.ndarray]:
        """The sorted keys that ``count`` gives for the texts, and the sum of each."""
        if isinstance(self.units, DataFrame):
            found = self.units.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        else:
            found = pa.Table.from_batches(list(count(iter(self.units))), pa.schema({"key": pa.int64(), "n": pa.int64()}))
        return _summed(found["key"].to_numpy(), found["n"].to_numpy())


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1])
    return keys[starts], np.add.reduceat(n[order], starts)


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Keys with their numbers, those of a task added up."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(*(np.concatenate(x) for x in zip(*held)))], names=["key", "n"])

    for own in found:
        held.append(own)
        size += len(own[0])
        if size >= GATHERED:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class _Language:
    """One language in all models of a fit: model f of HELD_OUT leaves out part f of the texts, the last one nothing.

    Units and bigrams have the same rows in all of them: first none, then the units, then the bigrams. In a model that has not
    seen a unit its gain is 0; a bigram that it has not seen twice has the gain of its unit.
    """

    def __init__(self, counts: pa.Table, n_subjects: int) -> None:
        no_v, no_u = (pc.is_null(counts[x]) for x in "vu")
        alone, before, pairs = counts.filter(no_v), counts.filter(no_u), counts.filter(pc.invert(pc.or_(no_v, no_u)))
        units = ["", *sorted(alone["u"].to_pylist())]
        self.n_units = len(units)
        values = pa.array(units, counts["u"].type)
        at = partial(pc.index_in, value_set=values)
        self.one, self.before = np.zeros((self.n_units, HELD_OUT), np.int64), np.zeros((self.n_units, HELD_OUT), np.int64)
        self.one[at(alone["u"]).to_numpy()] = _by_part(alone)
        self.before[at(before["v"]).to_numpy()] = _by_part(before)
        v, u = (at(pairs[x]).to_numpy().astype(np.int64) for x in "vu")
        keys = (v + 1) * (self.n_units + 1) + u + 1
        order = np.argsort(keys)
        self.v, self.u, self.two = v[order], u[order], _by_part(pairs)[order]
        self.models = LanguageModels(n_subjects)
        self.models.number = _Numbers({x: 1 + k for k, x in enumerate(units)})
        self.models.pairs, self.models.pair_rows = keys[order], 1 + self.n_units + np.arange(len(order))

    @property
    def n_rows(self) -> int:
        return 1 + self.n_units + len(self.v)

    def estimate(self, m: int, weighted: Iterator[np.ndarray], n_subjects: int) -> np.ndarray:
        """Gains of model m. ``weighted``: by subject, what counts for it of each row, and then of each unit as one before another."""
        w2, w1, w0 = WEIGHTS
        one, before, two = (x.sum(1) - (x[:, m] if m < HELD_OUT else 0) for x in (self.one, self.before, self.two))
        kept, v, u = two >= 2, self.v, self.u
        p1 = one / max(1.0, one.sum())
        with np.errstate(divide="ignore", invalid="ignore"):
            p2 = np.where(kept, two / before[v], 0.0)
        gain = np.zeros((self.n_rows, n_subjects), np.float32)
        for s, counts in enumerate(weighted):
            c1, c2, cv = np.split(counts[1:], [self.n_units, self.n_rows - 1])
            if not c1.any():
                gain[1:, s] = math.log(w0)
                continue
            q1 = _towards(c1, c1.sum() * p1) / c1.sum()
            with np.errstate(divide="ignore", invalid="ignore"):
                q2 = np.where(cv[v] > 0, _towards(c2, cv[v] * p2) / cv[v], p2)
                base = w2 * p2 + (w1 + w0) * p1[u]
                gain[1 : 1 + self.n_units, s] = np.log(((w2 + w1) * q1 + w0 * p1 + 1e-12) / (p1 + 1e-12))
                gain[1 + self.n_units :, s] = np.log((w2 * q2 + w1 * q1[u] + w0 * base) / (w2 * p2 + w1 * p1[u] + w0 * base))
        gain[1 : 1 + self.n_units][one == 0] = 0
        gain[1 + self.n_units :][~kept] = gain[1 + u[~kept]]
        return gain


def _by_part(counts: pa.Table) -> np.ndarray:
    return np.stack([counts[n].to_numpy().astype(np.int64) for n in _BY_PART], axis=1).reshape(-1, HELD_OUT)


class _Round:
    """What the tasks of a round need: the models of each language, and the gains of the last round, by model, if there was one."""

    def __init__(self, languages: dict[int, _Language], n_subjects: int, gains: dict[int, list[np.ndarray]] | None, clear: float | None) -> None:
        self.models = {k: x.models for k, x in languages.items()}
        self.first_before = {k: x.n_rows for k, x in languages.items()}
        self.width = max((x.n_rows + 1 + x.n_units for x in languages.values()), default=1)
        self.n_subjects, self.gains, self.clear = n_subjects, gains, clear

    def start(self, k: int, s: int) -> int:
        """The first key of language k and subject s, the number after the last subject being none; keys go on by the models that count, a bit for each, and by row."""
        return (k * (self.n_subjects + 1) + s) * (1 << HELD_OUT + 1) * self.width

    def ids(self, k: int, texts: _Texts, codes: np.ndarray) -> np.ndarray:
        number = self.models[k].number
        return np.array([number[x] for x in texts.words.to_pylist()], np.int64)[codes]


def _per_token(gain: np.ndarray, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.add.reduceat(gain[rows], starts, axis=0) / lengths[:, None].astype(np.float32)


def _subject_of(gains: np.ndarray, allowed: np.ndarray, accept: float, clear: float | None) -> np.ndarray:
    """The subject that each sentence counts for: the best of its text's, in later rounds another that is clearly better, else the number after the last."""
    at = np.arange(len(gains))
    top = np.where(allowed, gains, -np.inf).argmax(1)
    good = np.where(allowed.any(1), gains[at, top], -np.inf) >= accept
    if clear is not None:
        free = gains.argmax(1)
        other = gains[at, free] >= clear
        top, good = np.where(other, free, top), good | other
    return np.where(good, top, gains.shape[1])


def _weighted(batches: Iterator[pa.RecordBatch], own: _Round, accept: float) -> Iterator[pa.RecordBatch]:
    """By language, subject and models: how often each unit, each bigram and each unit before another counts."""
    return _gathered(x for texts in _texts(batches, own.n_subjects) for k in own.models for x in _weighted_of(texts, k, own, accept))


def _weighted_of(texts: _Texts, k: int, own: _Round, accept: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at, starts, codes = texts.of_language(k)
    if not len(at):
        return
    models, lengths, part = own.models[k], texts.lengths[at], texts.part[texts.owner[at]]
    ids = own.ids(k, texts, codes)
    before, rows = models.rows_at(ids, starts)
    # Sentences that count alike are counted together. lines: for each such kind, a subject (below 0: none of this line), the models it counts in, and its weight.
    if own.gains is None:
        kinds: dict[tuple[int, ...], int] = {}
        of_text = np.array([kinds.setdefault((f, *x), len(kinds)) for f, x in zip(texts.part.tolist(), texts.labels)], np.int64)
        kind_of = of_text[texts.owner[at]]
        most = max(len(x) for x in kinds)
        subject = np.array([[*x[1:], *[-1] * (most - len(x))] for x in kinds], np.int64).reshape(len(kinds), -1)
        weight = np.array([WHOLE // max(1, len(x) - 1) for x in kinds], np.int64)
        kind_part = np.array([x[0] for x in kinds], np.int64)
        lines = [(subject[:, j], (1 << HELD_OUT + 1) - 1 - (1 << kind_part), weight) for j in range(subject.shape[1])]
    else:
        allowed = texts.named(own.n_subjects)[texts.owner[at]]
        chosen = [np.where(part == m, -1, _subject_of(_per_token(own.gains[k][m], rows, starts, lengths), allowed, accept, own.clear)) for m in range(HELD_OUT + 1)]
        distinct, kind_of = np.unique(np.stack(chosen), axis=1, return_inverse=True)
        agree = [sum((distinct[j] == own_subject).astype(np.int64) << j for j in range(HELD_OUT + 1)) for own_subject in distinct]
        lines = [(np.where(agree[m] & ((1 << m) - 1), -1, distinct[m]), agree[m], np.ones(distinct.shape[1], np.int64)) for m in range(HELD_OUT + 1)]
    kind_of = np.repeat(kind_of.reshape(-1), lengths)
    paired = rows > len(models.number)
    key = np.concatenate([kind_of * own.width + ids, (kind_of * own.width + rows)[paired], kind_of * own.width + own.first_before[k] + before - 1])
    key, n = np.unique(key, return_counts=True)
    kind, slot = np.divmod(key, own.width)
    for subject_of, models_of, weight_of in lines:
        counts = subject_of[kind] >= 0
        of = kind[counts]
        yield own.start(k, 0) + subject_of[of] * own.start(0, 1) + models_of[of] * own.width + slot[counts], n[counts] * weight_of[of]


def _agreement(batches: Iterator[pa.RecordBatch], own: _Round) -> Iterator[pa.RecordBatch]:
    """By threshold and subject: texts whose labels the models of the other parts hit, those they add to, those they miss."""
    return _gathered(_agreement_of(texts, own) for texts in _texts(batches, own.n_subjects))


def _agreement_of(texts: _Texts, own: _Round) -> tuple[np.ndarray, np.ndarray]:
    best, gain = np.zeros(len(texts.lengths), np.int64), np.full(len(texts.lengths), -np.inf, np.float32)
    for k, models in own.models.items():
        at, starts, codes = texts.of_language(k)
        if not len(at):
            continue
        lengths, part = texts.lengths[at], texts.part[texts.owner[at]]
        rows = models.rows_at(own.ids(k, texts, codes), starts)[1]
        for f in np.unique(part).tolist():
            here = part == f
            own_rows = rows[np.repeat(here, lengths)]
            gains = _per_token(own.gains[k][f], own_rows, np.cumsum(lengths[here]) - lengths[here], lengths[here])
            best[at[here]], gain[at[here]] = gains.argmax(1), gains.max(1)
    named, n = texts.named(own.n_subjects), []
    for limit in THRESHOLDS:
        about = gain >= np.float32(limit)
        hits = np.zeros((len(texts.sizes), own.n_subjects))
        np.add.at(hits, (texts.owner[about], best[about]), 1)
        found = (hits >= LEAST_SHARE * texts.sizes[:, None] - 1e-9) & (texts.sizes[:, None] > 0)
        n += [(found & named).sum(0), (found & ~named).sum(0), (~found & named).sum(0)]
    return np.arange(len(n) * own.n_subjects), np.concatenate(n).astype(np.int64)


def fit_models(labelled: DataFrame | list[tuple[str, list[str]]], subjects: list[str], rounds: int = 4, clear: float = 0.25) -> SubjectModels:
    """Models from all texts with their raters' subjects (``text``, ``subjects``), incomplete and in part wrong.

    First each sentence counts for all subjects of its text. Then it counts for the one among these that the models of
    the last round prefer; in later rounds also for another subject that they prefer clearly; else for all subjects
    alike. Thresholds are set per subject by agreement with the labels of all texts, each judged by models of the parts
    that it is not in; the models that are given back are fitted on all.

    The texts of a DataFrame stay in the cluster: a round adds up whole numbers in its tasks, so that the sums are the
    same however the texts are dealt out, and the driver gets a line for each unit or bigram, model and subject.
    """
    fitted = SubjectModels(subjects)
    if not subjects:
        return fitted
    n, accept = len(subjects), float(fitted.accept[0])
    texts = _Counted(labelled, subjects)
    counts = texts.vocabulary()
    languages = {k: _Language(counts.filter(pc.equal(counts["language"], k)), n) for k in range(len(LANGUAGES)) if pc.any(pc.equal(counts["language"], k)).as_py()}
    if not languages:
        return fitted
    own = _Round(languages, n, None, None)
    for step in range(rounds):
        keys, sums = texts.sums(partial(_weighted, own=own, accept=accept))
        gains = {k: [lang.estimate(m, _by_subject(keys, sums, own, k, m, lang), n) for m in range(HELD_OUT + 1)] for k, lang in languages.items()}
        own = _Round(languages, n, gains, clear if step >= 1 else None)
    for k, lang in languages.items():
        lang.models.gain = own.gains[k][HELD_OUT]
        fitted.languages[LANGUAGES[k]] = lang.models
    fitted.accept = _thresholds(texts, own)
    return fitted


def _by_subject(keys: np.ndarray, sums: np.ndarray, own: _Round, k: int, m: int, language: _Language) -> Iterator[np.ndarray]:
    """What counts for each subject. Sentences of no subject count for all by size, so that they tell none of them from the background."""

    def of(s: int) -> np.ndarray:
        a, b = np.searchsorted(keys, [own.start(k, s), own.start(k, s + 1)])
        models, row = np.divmod(keys[a:b] - own.start(k, s), own.width)
        counts = (models >> m & 1).astype(bool)
        return np.bincount(row[counts], sums[a:b][counts], language.n_rows + language.n_units)

    if own.gains is None:
        yield from (of(s) / WHOLE for s in range(own.n_subjects))
        return
    mass = np.array([of(s)[1 : 1 + language.n_units].sum() for s in range(own.n_subjects)])
    none = of(own.n_subjects)
    yield from (of(s) + none * (mass[s] / max(1.0, mass.sum())) for s in range(own.n_subjects))


def _thresholds(texts: _Counted, own: _Round) -> np.ndarray:
    """Per subject the limit that agrees best with the labels of all texts, by the models that have not seen them."""
    keys, sums = texts.sums(partial(_agreement, own=own))
    n = np.zeros(len(THRESHOLDS) * 3 * own.n_subjects, np.int64)
    n[keys] = sums
    hit, wrong, miss = n.reshape(len(THRESHOLDS), 3, own.n_subjects).transpose(1, 0, 2)
    agree = np.round(2 * hit / np.maximum(1, 2 * hit + wrong + miss), 3)
    near = -np.abs(np.array(THRESHOLDS) - 0.06)
    return np.array([max((agree[j, k], near[j], limit) for j, limit in enumerate(THRESHOLDS))[2] for k in range(own.n_subjects)], np.float32)


def labelled_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, subjects): all labelled texts with their subjects; repeated labels count once.

    The labels are written first, so that their size is known: texts are shuffled only where these are too many to broadcast.
    """
    rows = written(labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects")))
    return documents.where("text is not null").select("doc_id", "text").join(rows, "doc_id").select("text", "subjects")


def _assign(batches: Iterator[pa.RecordBatch], models: SubjectModels, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, names, shares = [], [], []
        texts = batch.column(1).to_pylist()
        for doc_id, own in zip(batch.column(0).to_pylist(), (x for a in range(0, len(texts), 500) for x in models.shares_of(texts[a : a + 500]))):
            for k, share in sorted(own.items()):
                if share >= least - 1e-9:
                    ids.append(doc_id)
                    names.append(models.subjects[k])
                    shares.append(share)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=["doc_id", "subject", "share"])


def subjects_of(documents: DataFrame, labels: DataFrame, subjects: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, subject, share): the subjects that at least ``least`` of a document's sentences are about.

    Null and empty texts, and texts of no subject, have no line. Models are fitted on all labelled documents; every
    document is read whole, without shuffle, with the models handed to the tasks.
    """
    names = [r.subject for r in subjects.where("subject is not null").select("subject").distinct().orderBy("subject").collect()]
    models = fit_models(labelled_texts(documents, labels), names)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return spread(documents.select("doc_id", "text")).mapInArrow(partial(_assign, models=models, least=least), f"doc_id {kind}, subject string, share double")
