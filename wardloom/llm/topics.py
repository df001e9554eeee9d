"""Subjects of documents by distributed latent Dirichlet topic models, one model per language.

1.  A vocabulary over all documents (:func:`vocabulary`), and each document as its sentences' word ids with
    its language (:func:`word_ids`).
2.  Variational EM (:func:`fit`).  A document has a Dirichlet mixture of its language's topics, each of its
    words one topic.  The start comes from the documents alone: words that meet each other least in
    documents, found one after another on the words' co-occurrence, start a topic each.  Every round runs
    over all documents where they lie; partitions return topic-word statistics of a fixed size, which are
    added up in a tree.  No term table has a part in the fit.
3.  Fitted topics are mapped to subjects through their top terms (:func:`map_topics`): the terms a reader
    found at the top of fitted topics are kept as a table of inspected terms.
4.  A sentence's subjects are those of its words' topics, common words left out; a document's subjects are
    those with at least a share of its proportions over sentences (:func:`assign`).

Everything that reaches the driver is bounded by vocabulary x topics.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.session import cut

# Terms found at the top of fitted topics, by subject, in the corpus' four languages.
INSPECTED_TERMS = {
    "law": "statute tribunal judge notary solicitor contract clause covenant injunction plaintiff verdict litigated arbitration jurisdiction affidavit gesetz urteil vertrag berufung klage recours contrat loi clause bail sentencia demanda ley arbitraje cláusula",
    "software": "compiler parser database kernel cache refactored deployment developer maintainer reviewer tester release container idempotent stateless deprecated server request branch scheduler thread debugged index queue stack übersetzer testlauf datenbank code serveur requête compilateur dépôt correctif módulo servidor compilador código consulta",
    "security": "attacker malware exploit phishing backdoor firewall intrusion encrypted vulnerability jailbreak honeypot quarantine payload worm credential angriff schadcode passwort intrusion pare-feu faille attaque vulnerabilidad cortafuegos cuarentena contraseña ataque",
    "finance": "loan invoice portfolio equity dividend budget ledger cashier accountant treasurer payroll tax yield hedge deposit kredit konto steuer zins dividende facture banque taxe bilan préstamo impuesto cuenta factura presupuesto",
    "medicine": "patient nurse surgeon diagnosis vaccine prescription symptom dose fracture therapy clinic pharmacist fever surgery transfusion befund fieber medikament impfung médica patiente fièvre ordonnance chirurgie fiebre dosis cirugía vacuna clínica",
    "science": "hypothesis experiment isotope particle telescope molecule geologist astronomer chemist botanist quantum spectrum fossil photon orbit gletscher isotop molekül messung spektrum hypothèse mesure télescope spectre isótopo molécula espectro hipótesis glaciar",
    "sport": "coach goalkeeper referee striker match tournament league penalty stadium championship captain relegated scored sprint playoff stadion trainer turnier staffel pokal entraîneur but médaille tournoi ligue estadio liga penalti entrenador torneo",
    "travel": "passenger luggage itinerary hostel ferry boarding passport visa hotel flight harbour guidebook innkeeper traveller campsite fähre gepäck grenze herberge quai vol ferry valise albergue equipaje vuelo frontera andén",
    "education": "lecturer textbook pupil teacher homework exam semester curriculum scholarship thesis classroom tutor syllabus diploma lesson schüler lehrer prüfung hausaufgabe unterricht élève cours devoir examen alumno libro texto tarea profesor",
    "cooking": "baker chef dough garlic oven simmered recipe soup saffron marinade roast vinegar pastry whisked skillet teig ofen pfanne gewürz suppe recette pâte four bouillon épice receta horno masa sopa ajo",
}
# Words that nearly every text of a language has, one line per language.
COMMON_TERMS = (
    "the and that it in of for said this with",
    "der die das und nicht mit aber ist ein zu",
    "le la les et pas mais est une pour des",
    "el los las y pero no qué por una con",
)
_LANGUAGES = tuple(frozenset(line.split()) for line in COMMON_TERMS)

_WORD = re.compile(r"[^\W\d_]+").findall
#: Words, and the signs that end a sentence: a stop, question or exclamation mark before a blank, and a line's end.
_PARTS = re.compile(r"[^\W\d_]+|[.!?…。](?=\s)|[\r\n]").findall
#: End of a sentence in a document's list of word ids, and a word outside the vocabulary.
STOP, UNKNOWN = -1, -2


@dataclass(frozen=True)
class Settings:
    """``least_docs`` and ``least_share`` (of a language's documents) bound the vocabulary from below, ``common``
    is the share above which a word says nothing, ``extra`` the number of topics besides one per subject,
    ``seeds`` the number of words per language on whose co-occurrence topics start."""

    least_docs: int = 3
    least_share: float = 0.001
    common: float = 0.25
    extra: int = 6
    seeds: int = 600
    rounds: int = 5
    inner: int = 3
    alpha: float = 0.1
    eta: float = 0.01


#: Words of a vocabulary that goes to the driver and to every task; a larger one is refused.
MOST_WORDS = 1_000_000


def language_of(words: set[str]) -> int:
    """The language whose common words a text has most of, by number; -1 for fewer than two of any."""
    hits = [len(words & common) for common in _LANGUAGES]
    most = max(hits)
    return hits.index(most) if most > 1 else -1


def vocabulary(docs: DataFrame, text: str, settings: Settings = Settings()) -> dict[str, tuple[int, ...]]:
    """Number of documents per language that have a word, for the words of the vocabulary.

    A language (told by its commonest words) keeps the words that are in at least ``least_docs`` and the
    share ``least_share`` of its documents; words in more than the share ``common`` of some language's
    documents are left out.  All documents count.  A language thus keeps at most as many words as a document
    has on average, divided by the share, however many documents there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(by_language: dict[int, Counter]) -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, words in by_language.items() for w, n in words.items()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

        counts: dict[int, Counter] = defaultdict(Counter)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    words = set(_WORD(t.lower()))
                    words.add("")  # counts the documents
                    counts[language_of(words)].update(words)
            if sum(map(len, counts.values())) > 500_000:
                yield pack(counts)
                counts.clear()
        yield pack(counts)

    found = cut(docs.select(text).mapInArrow(count, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where("lang >= 0"))
    totals = {r.lang: r.n for r in found.where("word = ''").collect()}
    low = high = F.lit(None).cast("double")
    for lang, n in totals.items():
        low = F.when(F.col("lang") == lang, F.lit(max(settings.least_share * n, float(settings.least_docs)))).otherwise(low)
        high = F.when(F.col("lang") == lang, F.lit(max(settings.common * n, float(settings.least_docs)))).otherwise(high)
    counts = F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == i, F.col("n"))), F.lit(0)) for i in range(len(_LANGUAGES))])
    kept = (
        found.where("word <> ''")
        .groupBy("word")
        .agg(F.max(F.coalesce(F.col("n") >= low, F.lit(False))).alias("enough"), F.max(F.coalesce(F.col("n") > high, F.lit(False))).alias("common"), counts.alias("counts"))
        .where("enough and not common")
        .select("word", "counts")
    )
    rows = kept.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"the vocabulary has more than {MOST_WORDS} words")
    return {r.word: tuple(r.counts) for r in sorted(rows, key=lambda r: (-sum(r.counts), r.word))}


def word_ids(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, tokens, lang): each document's vocabulary words as ids, :data:`STOP` at the end of each sentence.

    A sentence ends at a stop, question or exclamation mark before a blank and at a line's end; one
    without letters is none.  Null, empty and blank texts have an empty list.  ``lang`` is -1 where a text
    has too few common words to tell.
    """
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value | dict.fromkeys(".!?…。\r\n", STOP)
        common = frozenset().union(*_LANGUAGES)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 1000):
                batch = whole.slice(at, 1000)
                flat: list[int] = []
                offsets, langs = [0], []
                for t in batch.column(1).to_pylist():
                    if t:
                        parts = _PARTS(t.lower())
                        flat += [ids.get(p, UNKNOWN) for p in parts]
                        flat.append(STOP)
                        langs.append(language_of(common.intersection(parts)))
                    else:
                        langs.append(-1)
                    offsets.append(len(flat))
                tokens, ends = np.array(flat, np.int32), np.array(offsets)
                first = np.zeros(len(tokens), bool)
                first[ends[:-1][ends[:-1] < ends[1:]]] = True
                # no end of a sentence where none has begun
                keep = (tokens != STOP) | ~(first | np.r_[True, tokens[:-1] == STOP][: len(tokens)])
                keep &= tokens != UNKNOWN
                ends = np.r_[0, np.cumsum(keep)][ends]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens[keep]))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.array(langs, np.int32))], names=[key, "tokens", "lang"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens array<int>, lang int")


@dataclass
class Model:
    """Topic-word probabilities (words x topics, the languages' topics one after another), each topic's subject or
    None, and the words' log frequencies per language."""

    words: list[str]
    phi: np.ndarray
    subjects: list[str | None]
    settings: Settings
    spoken: np.ndarray

    def of(self, lang: int) -> slice:
        """The topics of a language."""
        k = len(self.subjects) // len(_LANGUAGES)
        return slice(lang * k, (lang + 1) * k)


def starting_topics(met: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Words x topics: the words that go with each of ``k`` words which meet each other least.

    ``met`` has the number of documents that two words share, ``docs`` the documents of each word.  A word is
    the distribution of the words it meets, less the mean of all; the first of the ``k`` lies farthest from
    it, each next one farthest from the span of those before.  Words in few documents start no topic.
    """
    share = met / np.maximum(met.sum(axis=1, keepdims=True), 1)
    able = np.flatnonzero(docs >= max(5.0, 0.1 * docs.mean())) if len(docs) else np.zeros(0, int)
    away = share[able] - (share[able].mean(axis=0) if len(able) else 0)
    out = np.zeros((len(docs), k))
    for j in range(min(k, len(able))):
        norms = (away * away).sum(axis=1)
        i = int(norms.argmax())
        if norms[i] <= 1e-12:
            break
        out[:, j] = share[able[i]]
        out[able[i], j] += 0.05
        v = away[i] / np.sqrt(norms[i])
        away = away - np.outer(away @ v, v)
    return out / np.maximum(out.sum(axis=0), 1e-300)


def infer(terms: np.ndarray, counts: np.ndarray, first: np.ndarray, phi: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Expected words per topic of each term of each document, and each document's topic weights.

    ``first`` is where each document's terms begin; every document has at least one.
    """
    n = np.diff(np.r_[first, len(terms)])
    p = phi[terms]
    theta = np.ones((len(first), phi.shape[1]), np.float32)
    for _ in range(settings.inner + 1):
        r = p * np.repeat(theta, n, axis=0)
        r *= (counts / r.sum(axis=1))[:, None]
        theta = np.add.reduceat(r, first, axis=0) + np.float32(settings.alpha)
    return r, theta


def _terms(tokens: np.ndarray, offsets: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a batch's documents with counts, where each document's begin, and which it is."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    is_word = tokens != STOP
    pairs, counts = np.unique(doc[is_word] * np.int64(n_words) + tokens[is_word], return_counts=True)
    own = pairs // n_words
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return (pairs % n_words).astype(np.int64), counts.astype(np.float32), first, own[first]


def _chunks(batches: Iterator[pa.RecordBatch], spoken: np.ndarray, rows: int = 500) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(language, keys, tokens, offsets) of documents of one language; where it is not told, the likeliest by the words."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy(zero_copy_only=False)
            tokens, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
            lang = batch.column(2).to_numpy(zero_copy_only=False).copy()
            odd = np.flatnonzero((lang < 0) & (size > 0))
            for d in odd:
                own = tokens[offsets[d] - offsets[0] : offsets[d + 1] - offsets[0]]
                lang[d] = int(spoken[own[own >= 0]].sum(axis=0).argmax())
            for one in np.unique(lang[(lang >= 0) & (size > 0)]):
                mine = lang == one
                yield int(one), batch.column(0).filter(pa.array(mine)), tokens[np.repeat(mine, size)], np.r_[0, np.cumsum(size[mine])]


def _added_up(parts: DataFrame, shape: tuple[int, int], fan_in: int = 16) -> np.ndarray:
    """Sum of the matrices in (part, m), in a tree so that no task and not the driver gets many."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros(shape[0] * shape[1])
        for raw in pdf["m"]:
            m += np.frombuffer(raw, dtype=np.float64)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "m": [m.tobytes()]})

    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan_in)
        parts = parts.withColumn("part", F.pmod("part", F.lit(n))).groupBy("part").applyInPandas(total, "part int, m binary")
    rows = parts.select("m").collect()  # one matrix
    return np.frombuffer(rows[0].m, dtype=np.float64).reshape(shape) if rows else np.zeros(shape)


def _over_documents(bags: DataFrame, key: str, spoken: np.ndarray, shape: tuple[int, int], shared, step: Callable) -> np.ndarray:
    """Sum over all documents of what ``step(shared value, language, tokens, offsets, statistics)`` adds to a partition's statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = shared.value
        stats = np.zeros(shape)
        for lang, _, tokens, offsets in _chunks(batches, spoken):
            step(own, lang, tokens, offsets, stats)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([stats.tobytes()], pa.binary())], names=["part", "m"])

    return _added_up(bags.select(key, "tokens", "lang").mapInArrow(run, "part int, m binary"), shape)


def fit(bags: DataFrame, key: str, words: dict[str, tuple[int, ...]], subjects: list[str], settings: Settings = Settings()) -> Model:
    """The topic models of all documents in ``bags`` (:func:`word_ids`), by ``rounds`` rounds of EM from topics that
    the words' co-occurrence starts (:func:`starting_topics`).  ``subjects`` give the number of topics, and the
    fitted topics their names."""
    langs, k, v = len(_LANGUAGES), len(subjects) + settings.extra, len(words)
    counts = np.array(list(words.values()), dtype=np.float64).reshape(v, langs)
    share = counts / np.maximum(counts.sum(axis=0), 1)
    spoken = np.log(share + 1e-7)
    seeds = [np.argsort(-counts[:, i], kind="stable")[: settings.seeds] for i in range(langs)]
    seeds = [s[counts[s, i] > 0] for i, s in enumerate(seeds)]
    place = np.full((langs, v), -1)
    for i, s in enumerate(seeds):
        place[i, s] = np.arange(len(s))
    sc = bags.sparkSession.sparkContext
    phi = np.zeros((v, langs * k))
    if v:
        size = min(settings.seeds, v)

        def meet(place: np.ndarray, lang: int, tokens: np.ndarray, offsets: np.ndarray, stats: np.ndarray) -> None:
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[tokens >= 0]
            at = place[lang, tokens[tokens >= 0]]
            has = np.zeros((len(offsets) - 1, size), np.float32)
            has[doc[at >= 0], at[at >= 0]] = 1
            stats[lang * size : (lang + 1) * size] += has.T @ has

        shared = sc.broadcast(place)
        met = _over_documents(bags, key, spoken, (langs * size, size), shared, meet)
        shared.unpersist()
        for i, s in enumerate(seeds):
            square = met[i * size : i * size + len(s), : len(s)].copy()
            docs = square.diagonal().copy()
            np.fill_diagonal(square, 0)
            own = np.zeros((v, k))
            own[s, 1:] = starting_topics(square, docs, k - 1)
            own[:, 0] = share[:, i]  # what all documents have in common
            phi[:, i * k : (i + 1) * k] = 0.7 * own + 0.3 * share[:, i : i + 1]

    def expect(phi: np.ndarray, lang: int, tokens: np.ndarray, offsets: np.ndarray, stats: np.ndarray) -> None:
        own = phi[:, lang * k : (lang + 1) * k]
        terms, n, first, _ = _terms(tokens, offsets, len(own))
        if len(first):
            r, _ = infer(terms, n, first, own, settings)
            for j in range(k):
                stats[lang * k + j] += np.bincount(terms, weights=r[:, j], minlength=len(own))

    for _ in range(settings.rounds if v else 0):
        shared = sc.broadcast((phi + 1e-12).astype(np.float32))
        stats = _over_documents(bags, key, spoken, (langs * k, v), shared, expect).T
        shared.unpersist()
        heard = stats.reshape(v, langs, k).sum(axis=(0, 2)) > 0
        phi = (stats + settings.eta) * np.repeat(heard, k)
        phi /= np.maximum(phi.sum(axis=0), 1e-300)
    model = Model(list(words), (phi + 1e-12).astype(np.float32), [None] * (langs * k), settings, spoken)
    model.subjects = map_topics(model, subjects)
    return model


def top_terms(model: Model, n: int = 30) -> list[list[str]]:
    """The terms that mark each topic most: frequent in it and more so than in its language's others."""
    out = []
    for lang in range(len(_LANGUAGES)):
        phi = model.phi[:, model.of(lang)].astype(np.float64)
        lift = phi * np.log(phi / phi.mean(axis=1, keepdims=True)) if len(phi) else phi
        out += [[model.words[i] for i in np.argsort(-lift[:, j], kind="stable")[:n] if lift[i, j] > 0.05 * lift[:, j].max()] for j in range(phi.shape[1])]
    return out


def map_topics(model: Model, subjects: list[str], n: int = 30, least: int = 3) -> list[str | None]:
    """Each topic's subject: the one with most inspected terms among the topic's top terms, ``least`` at least."""
    known = {s: set(_WORD(INSPECTED_TERMS.get(s, s))) for s in subjects}
    out: list[str | None] = []
    for terms in top_terms(model, n):
        hits = {s: len(known[s].intersection(terms)) for s in subjects}
        best = max(subjects, key=lambda s: (hits[s], s), default=None)
        out.append(best if best is not None and hits[best] >= least else None)
    return out


def assign(bags: DataFrame, key: str, model: Model, share: float = 0.15, heard: float = 1.0) -> DataFrame:
    """(key, subject, proportion): the subjects with at least ``share`` of a document's proportions.

    A sentence's proportions are the expected topics of its words given the document, over those topics
    that have a subject; one whose words have less than ``heard`` words' worth of them is about none.  A
    document's proportions are the means over its sentences.  Documents without sentences have no subject.
    Equal texts have equal subjects: nothing but the text and the model enters.
    """
    names = sorted({s for s in model.subjects if s})
    shared = bags.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        into = np.zeros((len(own.subjects), len(names)), np.float32)
        for j, s in enumerate(own.subjects):
            if s:
                into[j, names.index(s)] = 1
        for lang, keys, tokens, offsets in _chunks(batches, own.spoken):
            terms, counts, first, docs = _terms(tokens, offsets, len(own.words))
            if not len(first) or not names:
                continue
            phi = own.phi[:, own.of(lang)]
            _, theta = infer(terms, counts, first, phi, own.settings)
            row = np.full(len(offsets) - 1, -1)
            row[docs] = np.arange(len(docs))
            stop = tokens == STOP
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            sentence = (np.cumsum(stop) - stop)[~stop]
            r = phi[tokens[~stop]] * theta[row[doc[~stop]]]
            r /= r.sum(axis=1, keepdims=True)
            starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
            mass = np.add.reduceat(r @ into[own.of(lang)], starts, axis=0).astype(np.float64)
            total = mass.sum(axis=1, keepdims=True)
            mass = np.where(total >= heard, mass / np.maximum(total, 1e-12), 0.0)
            by_doc = np.zeros((len(offsets) - 1, len(names)))
            np.add.at(by_doc, doc[~stop][starts], mass)
            n = np.maximum(np.bincount(doc[stop], minlength=len(offsets) - 1), 1)
            # rounded, so that the place of a text in a batch cannot matter
            p = np.round(by_doc / n[:, None], 4)
            rows, columns = np.nonzero(p >= share)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows)), pa.array([names[c] for c in columns], pa.string()), pa.array(p[rows, columns], pa.float64())],
                names=[key, "subject", "proportion"],
            )

    kind = bags.schema[key].dataType.simpleString()
    return bags.select(key, "tokens", "lang").mapInArrow(run, f"`{key}` {kind}, subject string, proportion double")
