"""Quality rules under weak supervision.

Every rule looks at counts of a text and votes good, bad or abstains; no rule repeats what the base already fails.  The votes of
all documents that pass the base are counted by pattern (at most 3**rules patterns, whatever the input).  Expectation-maximisation on these counts
starts from the majority of votes and learns from the rules' agreement how often each one votes bad among good and among bad
documents, and how many documents are good.  A vote weighs as much as its rule was found to tell the two apart, so accurate
rules outvote others; a document is kept if its posterior probability of being good is at least the threshold.

Defined results: a null or empty text has no words, so it fails the base, and every rule abstains on it; long texts are read
whole; repeated rows get the same verdict and each counts as a document in the estimates; an empty table gives no rows, and
without a document that passes the base no vote weighs anything; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches, written
from ._text import U64, WHITE, flat, mix, runs, settled, shingles, spans_hash, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_stops", "n_marks", "n_bare", "n_points", "n_echo"]
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _of(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many True lie in each document."""
    return np.diff(np.r_[0, np.cumsum(mask)][offsets])


def _repeated(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more in its document, occurred before in it) of each entry."""
    both = mix(key + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    same = ranked[1:] == ranked[:-1]
    later = np.zeros(len(key), bool)
    twice = np.zeros(len(key), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text."""
    raw_all, off_all = flat(texts)
    out: dict[str, list[np.ndarray]] = {k: [] for k in COUNTS}
    for a, b in runs(off_all):
        raw, offsets = raw_all[off_all[a] : off_all[b]], off_all[a : b + 1] - off_all[a]
        n = b - a
        start, end, first = words(raw, offsets)
        count = np.diff(first)
        doc = np.repeat(np.arange(n), count)
        letter = ((raw | 32) >= ord("a")) & ((raw | 32) <= ord("z")) & (raw < 128)
        out["n_words"].append(count)
        out["word_chars"].append(_of(((raw & 0xC0) != 0x80) & ~WHITE[raw], offsets))
        out["n_symbols"].append(_of(SYMBOLS[raw], offsets))
        out["n_upper"].append(_of(letter & (raw < ord("a")), offsets))
        out["n_letters"].append(_of(letter, offsets))
        out["n_stops"].append(_of((raw == ord(".")) | (raw == ord(",")), offsets))
        out["n_marks"].append(_of(raw == ord("!"), offsets))
        digit = (raw >= ord("0")) & (raw <= ord("9"))
        out["n_points"].append(_of((raw < 128) & ~letter & ~digit & ~WHITE[raw], offsets))
        inked = np.r_[0, np.cumsum(letter | digit | (raw >= 128))]
        out["n_bare"].append(np.bincount(doc[inked[end] == inked[start]], minlength=n))
        key = spans_hash(raw, start, end, fold=False)
        echo = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
        out["n_echo"].append(np.bincount(doc[1:][echo], minlength=n))
        # lines
        breaks = np.flatnonzero(raw == 10)
        line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        line_end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
        line_doc = np.repeat(np.arange(n), 1 + _of(raw == 10, offsets))
        has = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
        out["n_lines"].append(np.bincount(line_doc[has], minlength=n))
        _, later = _repeated(line_doc[has], spans_hash(raw, line_start[has], line_end[has], fold=False)) if has.any() else (None, np.zeros(0, bool))
        out["n_dup_lines"].append(np.bincount(line_doc[has][later], minlength=n))
        # windows of five words that return within the text
        repeat = np.zeros(n, np.int64)
        if len(start) >= 5:
            spot = np.flatnonzero(doc[:-4] == doc[4:])
            long_enough = np.where(count >= 5, first[1:] - first[:-1], 0)
            wdoc, window = shingles(key, first)
            full = long_enough[wdoc] > 0
            twice, _ = _repeated(wdoc[full], window[full])
            cover = np.zeros(len(start) + 1, np.int64)
            np.add.at(cover, spot[twice], 1)
            np.add.at(cover, spot[twice] + 5, -1)
            repeat = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
        out["n_repeat_words"].append(repeat)
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


def counts_column(text: Column | str) -> Column:
    """struct of the counts of a text."""

    @F.arrow_udf("struct<" + ", ".join(f"{k}: bigint" for k in COUNTS) + ">")
    @settled
    def counts(texts: pa.Array) -> pa.Array:
        found = count_texts(texts)
        return pa.StructArray.from_arrays([pa.array(found[k], pa.int64()) for k in COUNTS], COUNTS)

    return counts(text)


@dataclass(frozen=True)
class Rule:
    """Two native conditions over the counts: bad wins over good, neither abstains."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0)


#: What fails whatever the rules say.
BASE = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
RULES = [
    Rule("length", "n_words between 1 and 19", "n_words >= 50"),
    Rule("word_size", "2 * word_chars < 5 * n_words or word_chars > 10 * n_words", "word_chars between 3 * n_words and 7 * n_words and n_words > 0"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words and n_words > 0"),
    Rule("points", "7 * n_points > word_chars", "12 * n_points <= word_chars and n_words > 0"),
    Rule("bare_words", "5 * n_bare > n_words", "20 * n_bare <= n_words and n_words > 0"),
    Rule("same_lines", "10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines and n_lines > 1"),
    Rule("returns", "10 * n_repeat_words > n_words", "25 * n_repeat_words <= n_words and n_words > 0"),
    Rule("shouting", "10 * n_upper > 3 * n_letters", "20 * n_upper <= 3 * n_letters and n_letters > 0"),
    Rule("stops", "n_words >= 50 and 50 * n_stops < n_words", "20 * n_stops >= n_words and n_words > 0"),
    Rule("echo", "10 * n_echo > n_words", "50 * n_echo <= n_words and n_words > 0"),
    Rule("marks", "10 * n_marks > n_words", "100 * n_marks <= n_words and n_words > 0"),
]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """(share of good documents, rates[rule, class]) by EM; patterns hold -1, 0 and 1.

    rates are the shares of bad votes among a rule's votes on bad and on good documents; one minus the latter is its accuracy
    on good documents.  Abstaining says nothing.  The first posterior is each pattern's share of good votes.  In every round a
    rule votes bad among bad documents no more rarely than among good ones, which fixes what the two classes mean.
    """
    against, cast = (patterns == -1).astype(float), (patterns != 0).astype(float)
    total, votes = counts.sum(), cast.sum(axis=1)
    good = (0.5 + (patterns == 1).sum(axis=1)) / (1 + votes)
    share, rates = 0.5, np.full((patterns.shape[1], 2), 0.5)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        fresh = ((weight @ against + 0.5) / (weight @ cast + 1)).T
        wrong = fresh[:, 0] < fresh[:, 1]
        fresh[wrong] = fresh[wrong].mean(axis=1, keepdims=True)
        fresh_share = float(((good * counts).sum() + 1) / (total + 2))
        moved = max(np.abs(fresh - rates).max(initial=0), abs(fresh_share - share))
        rates, share = fresh, fresh_share
        good = posterior(patterns, share, rates)
        if moved < 1e-9:
            break
    return share, rates


def weights(share: float, rates: np.ndarray) -> tuple[float, np.ndarray]:
    """(log odds of good before any vote, what a bad and a good vote of each rule add[rule, 2])."""
    return math.log(share / (1 - share)), np.stack([np.log(rates[:, 1] / rates[:, 0]), np.log((1 - rates[:, 1]) / (1 - rates[:, 0]))], axis=1)


def posterior(patterns: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
    start, add = weights(share, rates)
    odds = start + (patterns == -1) @ add[:, 0] + (patterns == 1) @ add[:, 1]
    return 1 / (1 + np.exp(-odds))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, the counts, base_failed, p_good, kept) of every row.

    One pass in Arrow batches makes the counts, which are written once to the shared folder; votes, pattern counts and the
    posterior are native.  The only shuffle is the pattern count.  Same-named columns cannot clash: only id and text are read.
    """
    rules = rules or RULES
    bounded_batches(docs.sparkSession)
    counted = written(docs.select(F.col(id_col).alias("doc_id"), counts_column(F.col(text_col)).alias("c")).select("doc_id", "c.*"), "rules", compact=True)
    votes = [f"vote_{r.name}" for r in rules]
    voted = counted.withColumns({v: r.vote() for v, r in zip(votes, rules, strict=True)}).withColumn("base_failed", F.expr(BASE))
    table = voted.filter(~F.col("base_failed")).groupBy(*votes).agg(F.count("*").alias("n")).collect()
    patterns = np.array([[r[v] for v in votes] for r in table], dtype=float).reshape(len(table), len(votes))
    start, add = weights(*estimate(patterns, np.array([r["n"] for r in table], dtype=float)))
    odds = F.lit(start)
    for v, (bad, good) in zip(votes, add.tolist(), strict=True):
        odds = odds + F.when(F.col(v) == -1, bad).when(F.col(v) == 1, good).otherwise(0.0)
    return voted.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
