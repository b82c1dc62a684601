"""Problem 10: subject areas of each document.

A seeded non-negative factorisation of the sentence-term matrix: one component per subject and a few for talk that is
about none. Components are anchored on labelled documents (a sentence of a document may use the components of its
labels, the background, and the others only faintly) and on the subjects' own titles and descriptions; alternating
multiplicative updates (Kullback-Leibler) fit sentence mixtures and component terms in turn. The fitted components are
applied to every document: each sentence's mixture is updated with fixed components, and a sentence is devoted to a
subject if that carries most of its mixture. A document has the subjects of at least three of its sentences.

The factorisation is fitted on the driver on a bounded sample: at most LABELLED documents with labels, drawn by hash of
the id (this is the one bounded sample; all documents are assigned, whole, in one pass without a shuffle). The
components (the terms of that sample by about 16 numbers) travel with the tasks. A task reads the sentences of many
documents together, as sparse products.

Sentences stand in for documents as rows of the matrix because a subject counts only where three sentences are devoted
to it; a document's mixture (subject_mixtures) is the mean of its sentences'.

Defined results: null, empty and one-word texts have no subject; very long texts are read whole; labels that occur
twice count once; labels of unknown subjects or documents are ignored; without any label the components rest on the
subjects' descriptions alone; repeated documents are assigned each; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.encoding import spread
from rollcall.session import broadcast_if_small

#: Bounds of the fit: labelled documents and subjects; its background components and their prior weight (a label has 1), rounds and prior of unlabelled subjects.
LABELLED, SUBJECTS, BACKGROUND, TALK, ROUNDS, FAINT = 5000, 1000, 6, 2.0, 60, 0.02
#: Rounds of a sentence's mixture, the telling terms that make a sentence devoted, and the sentences a subject needs.
STEPS, DEVOTED, SENTENCES = 12, 0.8, 3
#: Turns of phrase seen at least this often with a subject that is the document's label less than this often only mention it.
SEEN, TRUE = 12, 0.5
#: Occurrences of terms that are updated at once, sentences a task remembers, documents a task takes at once.
CHUNK, MEMO, DOCUMENTS = 1 << 16, 1 << 17, 2048
OTHER = "(other)"
_CONTROL = bytes(c for c in (*range(32), 127) if c != 10)
_BREAK = re.compile(r"(?:(?<!\bno)[.!?]+(?=\s|$)|\n)+")
_WORD = re.compile(r"[a-z]+(?:[-'][a-z]+)*|\d+")
_TAGS = re.compile(r"</?(?:p|br|div|li|ul|ol|h\d|tr|td|table)(?![a-z])[^<>]*>", re.I)
# Letters that don't decompose, by their base letter.
_FOLD = {"đ": "d", "ø": "o", "ł": "l", "ß": "s", "æ": "a", "’": "'"}


def plain(text: str) -> str:
    """Lower case base letters; markup as line breaks; what is neither letter, ASCII nor line break dropped in place."""
    if "<" in text:
        text = re.sub(r"<[^<>\n]*>", "", _TAGS.sub("\n", text))
    if "&" in text:
        text = re.sub(r"&(?:nbsp|#160|#xa0);", " ", text.replace("&amp;", "&"))
    if any(c in text for c in "\r\t\v\f"):
        text = re.sub(r"\s*[\r\t\v\f]\s*", lambda m: "" if len(m[0]) > 1 else " ", text)
    if text.isascii():
        return text.lower().encode().translate(None, _CONTROL).decode()
    text = unicodedata.normalize("NFKD", text).lower()
    for c, base in _FOLD.items():
        text = text.replace(c, base)
    return text.encode("ascii", "ignore").translate(None, _CONTROL).decode()


def sentences(text: str | None) -> list[str]:
    """Folded sentences of a text; numbers are one digit."""
    return [s for s in map(str.strip, _BREAK.split(_NUMBER.sub("0", plain(text)))) if s] if text else []


_NUMBER = re.compile(r"\d+")


def terms(sentence: str) -> list[str]:
    """Words and pairs of neighbouring words."""
    words = [w if not w[0].isdigit() else "#" for w in _WORD.findall(sentence)]
    words = [w for w in words if w != "#"]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _chunks(lists: list[list[int]]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Sentences (lists of term numbers, none empty) some at a time: (which, where each begins, their lengths, all terms)."""
    sizes = np.array([len(x) for x in lists], np.int64)
    lo = 0
    while lo < len(lists):
        hi = min(len(lists), lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + CHUNK]), CHUNK, "right"))))
        yield slice(lo, hi), np.r_[0, np.cumsum(sizes[lo:hi])[:-1]], sizes[lo:hi], np.concatenate(lists[lo:hi]).astype(np.int64)
        lo = hi


def _step(w: np.ndarray, own: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mass of each term by component, its sums by sentence): one update of the mixtures w of a chunk, as one sparse product."""
    mass = np.repeat(w, sizes, 0) * own
    mass /= np.maximum(mass.sum(1, keepdims=True), 1e-30)
    return mass, np.add.reduceat(mass, starts, 0)


class Components:
    """Terms by components; the first ones are the subjects. telling: how far a term tells one subject from the rest, 0 to 1."""

    def __init__(self, subjects: list[str], vocabulary: dict[str, int], weights: np.ndarray, telling: np.ndarray):
        self.subjects, self.vocabulary, self.weights, self.telling = subjects, vocabulary, weights.astype(np.float32), telling.astype(np.float32)
        self.mentions: set[str] = set()

    def known(self, sentence: str) -> tuple[list[int], bool]:
        """(terms of the vocabulary, whether a turn of phrase only mentions a subject)."""
        found = terms(sentence)
        return [self.vocabulary[t] for t in found if t in self.vocabulary], bool(self.mentions) and not self.mentions.isdisjoint(found)

    def read(self, sentences_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(subject each sentence is devoted to or -1, mixtures over all components) of a list of sentences.

        A sentence is devoted to the subject most of its telling terms belong to, if they are enough and twice those of any
        other. A sentence without a known term is all background.
        """
        k = len(self.subjects)
        subject = np.full(len(sentences_), -1, np.int64)
        mixed = np.zeros((len(sentences_), len(self.weights)), np.float32)
        mixed[:, k:] = 1 / max(1, len(self.weights) - k)
        lists, mention = zip(*map(self.known, sentences_)) if sentences_ else ((), ())
        some = np.array([i for i, x in enumerate(lists) if x], np.int64)
        table = np.ascontiguousarray(self.weights.T)
        for which, starts, sizes, found in _chunks([lists[i] for i in some]):
            own, w = table[found], np.full((len(sizes), len(self.weights)), 1 / len(self.weights), np.float32)
            for _ in range(STEPS):
                mass, w = _step(w, own, starts, sizes)
                w /= sizes[:, None].astype(np.float32)
            mixed[some[which]] = w
            told = np.add.reduceat(mass[:, :k] * self.telling[found][:, None], starts, 0)
            best = told.argmax(1)
            first = told[np.arange(len(told)), best]
            told[np.arange(len(told)), best] = 0
            sure = (first >= DEVOTED) & (first >= 2 * told.max(1, initial=0))
            subject[some[which]] = np.where(sure, best, -1)
        subject[np.array(mention, bool)] = -1
        return subject, mixed

    def documents(self, texts: list[str | None], memo: dict[str, tuple[int, np.ndarray]]) -> list[tuple[Counter, np.ndarray, int]]:
        """(sentences devoted to each subject, sum of the sentences' mixtures, sentences) of texts. Sentences repeat, so memo keeps those read before."""
        split = [sentences(t) for t in texts]
        new = list(dict.fromkeys(s for x in split for s in x if s not in memo))
        subject, mixed = self.read(new)
        memo.update(zip(new, zip(subject.tolist(), mixed)))
        out = []
        for x in split:
            got = [memo[s] for s in x]
            out.append((Counter(k for k, _ in got if k >= 0), np.sum([m for _, m in got], 0) if got else np.zeros(len(self.weights), np.float32), len(x)))
        if len(memo) > MEMO:
            memo.clear()
        return out

    def counts(self, text: str | None) -> Counter:
        """How many sentences of a text are devoted to each subject."""
        return Counter({self.subjects[k]: n for k, n in self.documents([text], {})[0][0].items()})

    def learn_mentions(self, documents: list[tuple[str, set[str]]]) -> None:
        """Finds turns of phrase (pairs of words that tell no subject) whose subject mostly isn't the document's."""
        right, seen = Counter(), Counter()
        split = [list(dict.fromkeys(sentences(text))) for text, _ in documents]
        every = list(dict.fromkeys(s for x in split for s in x))
        subject = dict(zip(every, self.read(every)[0].tolist()))
        for x, (_, labels) in zip(split, documents):
            for s in x:
                k = subject[s]
                if k >= 0:
                    pairs = {t for t in terms(s) if " " in t and t in self.vocabulary and self.telling[self.vocabulary[t]] < 0.3}
                    seen.update(pairs)
                    if self.subjects[k] in labels:
                        right.update(pairs)
        self.mentions = {t for t, n in seen.items() if n >= SEEN and right[t] < TRUE * n}


def fit(documents: list[tuple[str, set[str]]], subjects: list[tuple[str, str]], seed: int = 3) -> Components:
    """Components from labelled documents [(text, labels)] and subjects [(name, title and description)]."""
    names = [s for s, _ in subjects]
    number = {s: k for k, s in enumerate(names)}
    anchors = [(s, {name}) for name, text in subjects for s in sentences(text.replace(",", "\n"))]
    rows = [(s, labels) for text, labels in documents for s in dict.fromkeys(sentences(text))] + anchors
    found = [terms(s) for s, _ in rows]
    df = Counter(t for x in found for t in set(x))
    own = {t for s, _ in anchors for t in terms(s)}
    vocabulary = {t: i for i, t in enumerate(t for t, n in sorted(df.items(), key=lambda x: (-x[1], x[0])) if n > 1 or t in own)}
    lists = [[vocabulary[t] for t in x if t in vocabulary] for x in found]
    keep = [i for i, x in enumerate(lists) if x]
    lists = [lists[i] for i in keep]
    k, b, v = len(names), BACKGROUND, max(len(vocabulary), 1)
    rng = np.random.default_rng(seed)
    w = np.full((len(keep), k + b), FAINT / max(k, 1), np.float32)
    w[:, k:] = TALK / b
    for i, r in enumerate(keep):
        known = [number[s] for s in rows[r][1] if s in number]
        for s in known:
            w[i, s] = 1.0 / len(known)
    prior = w / w.sum(1, keepdims=True)
    h = np.full((k + b, v), 1e-6)
    if lists:
        at, col = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
        for j in range(k + b):
            h[j] += np.bincount(col, prior[at, j] * rng.uniform(0.8, 1.2, len(col)), v)
    h /= h.sum(1, keepdims=True)
    w, total = prior.copy(), np.zeros((k + b, v))
    for _ in range(ROUNDS):
        total[:] = 0
        table = np.ascontiguousarray(h.T, np.float32)
        for which, starts, sizes, col in _chunks(lists):
            mass, mixed = _step(w[which], table[col], starts, sizes)
            for j in range(k + b):
                total[j] += np.bincount(col, mass[:, j], v)
            mixed *= prior[which]
            w[which] = mixed / np.maximum(mixed.sum(1, keepdims=True), 1e-30)
        h = total + 0.01
        h /= h.sum(1, keepdims=True)
    share = total + 0.05
    share /= share.sum(0)
    own = share[:k] / np.maximum(share[:k].sum(0), 1e-30)
    telling = share[:k].sum(0) * (1 + (own * np.log(np.maximum(own, 1e-30))).sum(0) / np.log(max(k, 2)))
    out = Components(names, vocabulary, h, telling)
    out.learn_mentions(documents)
    return out


def fit_on(documents: DataFrame, labels: DataFrame, subjects: DataFrame, limit: int = LABELLED) -> Components:
    """Components fitted on at most `limit` labelled documents, the first by hash of their id."""
    pairs = labels.filter("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    pairs = pairs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    got = documents.select("doc_id", "text").join(broadcast_if_small(pairs), "doc_id").filter("text is not null").select("text", "labels").collect()
    known = sorted((r["subject"], f"{r['title_vi']}, {r['description']}") for r in subjects.filter("subject is not null").select("subject", F.coalesce("title_vi", F.lit("")).alias("title_vi"), F.coalesce("description", F.lit("")).alias("description")).limit(SUBJECTS + 1).collect())
    if len(known) > SUBJECTS:
        raise ValueError(f"more than {SUBJECTS} subjects")
    return fit(sorted((r["text"], set(r["labels"])) for r in got), known)


def _read(components: Components, rows_of: Callable, schema: str) -> Callable[[DataFrame], DataFrame]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[int, np.ndarray]] = {}
        columns = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            for lo in range(0, len(pdf), DOCUMENTS):
                part = pdf.iloc[lo : lo + DOCUMENTS]
                rows = [(i, *row) for i, got in zip(part["doc_id"], components.documents(list(part["text"]), memo)) for row in rows_of(*got)]
                yield pd.DataFrame(rows, columns=columns)

    return lambda documents: spread(documents.select("doc_id", "text")).mapInPandas(run, schema)


def assign_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, sentences_needed: int = SENTENCES) -> DataFrame:
    """(doc_id, subject, n_sentences) of every document's subjects."""
    components = fit_on(documents, labels, subjects)

    def rows(count: Counter, mixed: np.ndarray, n: int) -> list[tuple]:
        return [(components.subjects[k], m) for k, m in count.items() if m >= sentences_needed]

    return _read(components, rows, "doc_id long, subject string, n_sentences int")(documents)


def subject_mixtures(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, share): every document's mixture, its sentences' mixtures averaged; what is about no subject is (other). Shares of a document add up to 1; one without sentences is (other) alone."""
    components = fit_on(documents, labels, subjects)
    k = len(components.subjects)

    def rows(count: Counter, mixed: np.ndarray, n: int) -> list[tuple]:
        part = mixed[:k] / n if n else np.zeros(k)
        return [*((s, float(x)) for s, x in zip(components.subjects, part)), (OTHER, float(1 - part.sum()))]

    return _read(components, rows, "doc_id long, subject string, share double")(documents)


def composition(mixed: DataFrame) -> DataFrame:
    """(subject, documents, share): how many documents a corpus holds of each subject, from subject_mixtures()."""
    per = mixed.groupBy("subject").agg(F.sum("share").alias("documents"), F.avg("share").alias("share"))
    return per.select("subject", F.round("documents", 3).alias("documents"), F.round("share", 6).alias("share"))
