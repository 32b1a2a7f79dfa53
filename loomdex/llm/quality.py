"""Text quality statistics, and a rule list that tells prose from lists, tables and junk.

The rule list is induced by incremental reduced-error pruning from documents of known kind, made from a bounded sample
of the corpus (labelled.py), and exported as one SQL CASE expression, which Spark evaluates natively over the statistics
of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, narrow, saved, wide
from .junk import FEATURES, features
from .labelled import documents
from .markup import detect

#: Texts that labelled documents are made from at most, and stop words that are sent to the executors at most.
SAMPLE, STOP_WORDS = 1000, 100_000
#: The order in which rules are sought: rows of cells tell a table of numbers from number soup; lists come last, as junk
#: in short lines looks like one.
KINDS = ("table", "junk", "list")
#: Statistics that rules may use.  The others vary with language, wrapping and length of what is prose all the same.
RULED = [FEATURES.index(x) for x in ("symbol_share", "table_share", "list_share", "letter_share", "broken_share", "hex_share", "hard_share", "distinct_share", "long_share")]


def _stop_words(stopwords: DataFrame, word_col: str) -> frozenset[str]:
    words = narrow(stopwords, word=F.lower(F.trim(F.col(f"`{word_col}`")))).where("word <> ''").distinct().limit(STOP_WORDS + 1).collect()
    if len(words) > STOP_WORDS:
        raise ValueError(f"more than {STOP_WORDS} stop words")
    return frozenset(r[0] for r in words)


def text_statistics(docs: DataFrame, stopwords: DataFrame, rules: list[tuple[Rule, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", word_col: str = "word") -> DataFrame:
    """One row per row of docs: doc_id, the statistics of FEATURES (null for null and blank texts), blank, and marked:
    whether the text holds markup (looked up for texts that a rule covers only, else null).

    words counts runs of letters and digits; mean_word_length is in characters; symbol_share is the share of visible
    characters that are neither letters nor digits; punct_share the share of non-blank lines that end in punctuation;
    stop_share the share of words in `stopwords` (trimmed, lower-cased).
    """
    stop = _stop_words(stopwords, word_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            texts = batch.column(1).to_pylist()
            blank = [not t or not t.strip() for t in texts]
            rows = [[None] * len(FEATURES) if no else features(t, stop) for t, no in zip(texts, blank)]
            full = np.flatnonzero(~np.array(blank, bool))
            x = np.array([rows[i] for i in full], float).reshape(len(full), len(FEATURES))
            covered = np.zeros(len(full), bool)
            for rule, _ in rules or []:
                covered |= _covers(rule, x)
            marked: list[bool | None] = [None] * len(texts)
            for i in full[covered].tolist():
                marked[i] = bool(detect(texts[i]))
            cols = [pa.array(c, pa.float64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(blank), pa.array(marked, pa.bool_())], names=["doc_id", *FEATURES, "blank", "marked"])

    schema = "doc_id bigint, " + ", ".join(f"{x} double" for x in FEATURES) + ", blank boolean, marked boolean"
    rows = narrow(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(run, schema)


def labelled_statistics(docs: DataFrame, stopwords: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", word_col: str = "word") -> DataFrame:
    """(label, FEATURES) of documents of known kind, made from about `sample` texts, those of least hashed id."""
    stop = _stop_words(stopwords, word_col)
    rows = narrow(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string")).where("doc_id is not null and text is not null")
    span = 1 << 32
    cut = span if (n := rows.count()) <= sample else span * sample // n
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < cut).limit(2 * sample).repartition(wide(docs), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            made = [(kind, *features(t, stop)) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for kind, t in documents(text, i)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["label", *FEATURES])

    return rows.mapInArrow(run, "label string, " + ", ".join(f"{x} double" for x in FEATURES))


Rule = list[tuple[int, bool, float]]  # conditions (feature, at least, threshold), all of which must hold


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, up, cut in rule:
        ok &= (x[:, j] >= cut) if up else (x[:, j] < cut)
    return ok


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    """Adds the condition of the greatest information gain until no negative example is covered."""
    rule: Rule = []
    live = np.ones(len(y), bool)
    while len(rule) < 4 and (~y[live]).any() and y[live].any():
        p, n = y[live].sum(), (~y[live]).sum()
        base = np.log2(p / (p + n))
        best = (1e-9, None)
        for j in RULED:
            v = x[live, j]
            order = np.argsort(v, kind="stable")
            v, pos = v[order], y[live][order]
            edge = np.flatnonzero((v[1:] > v[:-1]) & (pos[1:] != pos[:-1]))
            if not len(edge):
                edge = np.flatnonzero(v[1:] > v[:-1])
            if not len(edge):
                continue
            below_p, below_n = np.cumsum(pos)[edge], np.cumsum(~pos)[edge]
            for up, a, b in ((True, p - below_p, n - below_n), (False, below_p, below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(a > 0, a * (np.log2(a / (a + b)) - base), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, up, float((v[edge[k]] + v[edge[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= _covers([best[1]], x)
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """Drops last conditions as long as that does not lower (right - wrong) / covered on the pruning set."""

    def worth(r: Rule) -> float:
        c = _covers(r, x)
        return (y[c].sum() - (~y[c]).sum()) / max(1, c.sum())

    best, score = rule, worth(rule)
    for end in range(len(rule) - 1, 0, -1):
        if (w := worth(rule[:end])) > score:
            best, score = rule[:end], w
    return best


def induce(x: np.ndarray, labels: np.ndarray, seed: int = 3) -> list[tuple[Rule, str]]:
    """An ordered rule list: for each of KINDS in turn, rules are grown on two thirds of the rows not yet
    covered, pruned on the rest, and kept until a pruned rule is wrong more often than right."""
    rng = np.random.default_rng(seed)
    out: list[tuple[Rule, str]] = []
    left = np.ones(len(x), bool)
    for kind in KINDS:
        open_ = left.copy()
        while (labels[open_] == kind).any():
            at = rng.permutation(np.flatnonzero(open_))
            y = labels[at] == kind
            pos, neg = at[y], at[~y]
            grow = np.concatenate((pos[: -(-2 * len(pos) // 3)], neg[: 2 * len(neg) // 3]))
            prune = np.concatenate((pos[-(-2 * len(pos) // 3) :], neg[2 * len(neg) // 3 :]))
            rule = _grow(x[grow], labels[grow] == kind)
            if not rule:
                break
            if len(prune):
                rule = _prune(rule, x[prune], labels[prune] == kind)
            hit = _covers(rule, x) & open_
            if not (labels[hit] == kind).any() or (labels[hit] == kind).mean() <= 0.5:
                break
            out.append((rule, kind))
            open_ &= ~hit
        for rule, k in out:
            if k == kind:
                left &= ~_covers(rule, x)
    return out


def to_case(rules: list[tuple[Rule, str]]) -> str:
    """The rule list as a SQL CASE expression over the columns of FEATURES."""
    parts = [f"WHEN {' AND '.join(f'{FEATURES[j]} {">=" if up else "<"} {cut!r}D' for j, up, cut in rule)} THEN '{kind}'" for rule, kind in rules]
    return f"CASE {' '.join(parts)} ELSE 'prose' END" if parts else "'prose'"


def fit_rules(labelled: DataFrame) -> list[tuple[Rule, str]]:
    """Induces the rules from labelled_statistics(), some eighteen rows for each text of its sample."""
    rows = saved(labelled).toPandas()
    if rows.empty:
        return []
    rows = rows.sort_values(["label", *FEATURES])  # the order of partitions does not count
    return induce(rows[FEATURES].to_numpy(float), rows["label"].to_numpy(str))


def text_kinds(docs: DataFrame, stopwords: DataFrame, sample: int = SAMPLE, **columns: str) -> DataFrame:
    """text_statistics() with kind, as the rule list says: prose, list, table or junk; null for null and blank texts."""
    rules = fit_rules(labelled_statistics(docs, stopwords, sample, **columns))
    statistics = text_statistics(docs, stopwords, rules, **columns)
    return statistics.withColumn("kind", F.when(~F.col("blank"), F.expr(to_case(rules))))
