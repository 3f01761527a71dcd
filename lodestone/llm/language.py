"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built from labelled text.  A text is parsed greedily into
phrases, each the longest match of what follows in the language's automaton; a letter that the
language lacks begins a phrase that what follows it continues.  Fewer phrases per character mean a closer language, and the
language that needs fewest, normalised by its own rate on held-back labelled text, wins (the first by
name of several).

Text is reduced to lower-case letters and single blanks.  Blocks of BLOCK characters are first parsed side
by side, each from the automaton's root, by table lookups in numpy: one lookup per character and
language for thousands of blocks at once.  Then each block is parsed again from the state in which the
block before it ends, until it meets the state of the first parse, from where on both agree.  So phrases span
blocks, and the result is that of one parse of the whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labelled characters per language that an automaton is built from, at most; the rest of the labelled
#: rows isn't needed. The bound on rows that are fetched for them, per language.
TRAIN_CHARS = 60_000
TRAIN_ROWS = 200
#: Characters per language, from further rows, on which the language's own phrase rate is measured.
RATE_CHARS = 20_000
#: Letters with a column of their own; the rest match nothing.
ALPHABET = 120
BLOCK = 512
#: Blocks parsed at once, and characters of a block whose states are kept for the second parse.
LANES = 8192
SYNC = 64
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


class Reducer:
    """Maps texts to arrays of symbols: 0 a letter outside the alphabet, 1 a blank, 2.. letters."""

    def __init__(self, alphabet: list[str]):
        self.alphabet = alphabet
        self.known = np.full(0x3000, 255, np.uint8)  # 255: not looked up yet
        self.symbol = {c: i + 2 for i, c in enumerate(alphabet)}
        self.rest: dict[int, int] = {}

    def _of(self, code: int) -> int:
        c = chr(code)
        if not c.isalpha():
            return 1
        return self.symbol.get(c.lower()[:1], 0)

    def __call__(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        low = codes < len(self.known)
        got = self.known[np.where(low, codes, 0)]
        fresh = np.unique(codes[low & (got == 255)])
        for code in fresh.tolist():
            self.known[code] = self._of(code)
        out = self.known[np.where(low, codes, 0)]
        if not low.all():
            for code in np.unique(codes[~low]).tolist():
                out[codes == code] = self._of(code)
        if not len(out):
            return out
        blank = out == 1
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        return out[keep]


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence: row state, column symbol, -1 none."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    to = np.full((len(step), width), -1, np.int32)
    for state, edges in enumerate(step):
        for c, target in edges.items():
            to[state, c] = target
    to[:, 0] = -1  # a letter outside the alphabet never matches
    return to


class CrossParser:
    def __init__(self, languages: list[str], alphabet: list[str], tables: list[np.ndarray], rates: list[float]):
        self.languages, self.rates, self.alphabet = languages, np.array(rates), alphabet
        self.width = tables[0].shape[1]
        bases = np.cumsum([0, *(len(t) for t in tables)])
        # one table for all languages; states are premultiplied by the width. Filled in place: the driver builds it
        whole = np.empty((bases[-1], self.width), np.int32)
        for t, b in zip(tables, bases.tolist()):
            part = whole[b : b + len(t)]
            np.add(t, np.int32(b), out=part)
            part *= np.int32(self.width)
            part[t < 0] = -1
        self.flat = whole.ravel()
        self.roots = (bases[:-1] * self.width).astype(np.int32)
        self.first = [np.where((f := self.flat[r : r + self.width]) < 0, r, f) for r in self.roots]  # the state after a phrase's first symbol

    def _run(self, j: int, columns: np.ndarray, live: np.ndarray, state: np.ndarray, keep: int) -> tuple:
        """(misses, end states, states and misses after each of the first `keep` characters) of blocks parsed from states.

        columns: a row per character, blocks by falling length; live: blocks that have that character.
        """
        count = np.zeros(len(state), np.int32)
        states, counts = np.full((keep, len(state)), -1, np.int32), np.zeros((keep, len(state)), np.int32)
        first = self.first[j]
        for at, m in enumerate(live.tolist()):
            if not m:
                break
            c = columns[at, :m]
            s = self.flat.take(state[:m] + c)
            miss = s < 0
            count[:m] += miss
            state[:m] = np.where(miss, first.take(c), s)
            if at < keep:
                states[at, :m], counts[at, :m] = state[:m], count[:m]
        return count, state, states, counts

    def misses(self, blocks: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases begun inside each block (rows by falling length) in each language.

        before: the row of the block before it in its text, -1 for a text's first.
        """
        n, out = len(blocks), np.zeros((len(blocks), len(self.languages)), np.int32)
        columns = np.ascontiguousarray(blocks.T).astype(np.int32)
        live = np.searchsorted(-lengths, -np.arange(1, blocks.shape[1] + 1), side="right")
        after = np.full(n, -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        for j in range(len(self.languages)):
            root = self.roots[j]
            count, end, states, counts = self._run(j, columns, live, np.full(n, root, np.int32), SYNC)
            total, alone = count.copy(), end.copy()
            again = np.flatnonzero((before >= 0) & (end[before] != root))
            while len(again):
                changed = []
                for at in range(0, len(again), LANES):
                    own = np.sort(again[at : at + LANES])  # by falling length
                    state, seen, left = end[before[own]].copy(), np.zeros(len(own), np.int32), own
                    for k in range(min(SYNC, blocks.shape[1])):
                        going = lengths[left] > k
                        if not going.all():  # ended without a meeting
                            stop = ~going
                            moved = left[stop][end[left[stop]] != state[stop]]
                            total[left[stop]], end[left[stop]] = seen[stop], state[stop]
                            changed.append(moved)
                            left, state, seen = left[going], state[going], seen[going]
                        if not len(left):
                            break
                        c = columns[k, left]
                        s = self.flat.take(state + c)
                        miss = s < 0
                        seen += miss
                        state = np.where(miss, self.first[j].take(c), s)
                        met = state == states[k, left]
                        if met.any():
                            done = left[met]
                            total[done] = seen[met] + count[done] - counts[k, done]
                            changed.append(done[end[done] != alone[done]])
                            end[done] = alone[done]
                            left, state, seen = left[~met], state[~met], seen[~met]
                    if len(left):  # rare: the rest of the block is parsed whole
                        start = min(SYNC, blocks.shape[1])
                        rest = np.searchsorted(-lengths[left], -np.arange(start + 1, blocks.shape[1] + 1), side="right")
                        more, last, _, _ = self._run(j, columns[start:, left], rest, state.copy(), 0)
                        total[left] = seen + more
                        changed.append(left[end[left] != last])
                        end[left] = last
                moved = np.concatenate(changed) if changed else np.zeros(0, np.int64)
                again = after[moved]
                again = again[again >= 0]
            out[:, j] = total
        return out

    def rate_of(self, arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases per character by language, characters) of each array of symbols; LANES blocks or one text at a time."""
        n = np.fromiter((len(a) for a in arrays), np.int64, len(arrays))
        parts = -(-n // BLOCK)
        total = np.zeros((len(arrays), len(self.languages)), np.int64)
        group = np.cumsum(parts) // LANES
        for own in np.split(np.arange(len(arrays)), np.flatnonzero(np.diff(group)) + 1) if len(arrays) else []:
            owner = np.repeat(own, parts[own])
            if not len(owner):
                continue
            number = np.arange(len(owner)) - np.repeat(np.cumsum(parts[own]) - parts[own], parts[own])
            lengths = np.minimum(BLOCK, n[owner] - number * BLOCK)
            order = np.argsort(-lengths, kind="stable")
            row = np.empty(len(order), np.int64)
            row[order] = np.arange(len(order))
            block = np.zeros((len(order), int(lengths.max())), np.uint8)
            for at, i in enumerate(order.tolist()):
                block[at, : lengths[i]] = arrays[owner[i]][number[i] * BLOCK : (number[i] + 1) * BLOCK]
            before = np.where(number[order] > 0, row[order - 1], -1)
            np.add.at(total, owner[order], self.misses(block, lengths[order], before))
        return (total + (n > 0)[:, None]) / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None], reducer: Reducer) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; UNKNOWN and 0 for a text without a letter."""
        arrays = [reducer(t) if isinstance(t, str) else np.zeros(0, np.uint8) for t in texts]
        rates, _ = self.rate_of(arrays)
        lettered = np.array([bool((a != 1).any()) for a in arrays], bool)
        relative = np.maximum(rates, 1e-9) / self.rates
        best = relative.argmin(axis=1) if len(arrays) else np.zeros(0, int)
        least = relative.min(axis=1) if len(arrays) else np.zeros(0)
        score = np.where(lettered, np.clip(1 / np.maximum(least, 1.0), 0, 1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())], score


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def split(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(text to learn from, text to measure the rate on) of a language: the first and the last part of its texts in line.

    The parts are as TRAIN_CHARS to RATE_CHARS whatever the number of texts, so the rate is never that of
    learned text; at most one text is cut in two.  Below four symbols there is nothing to hold back.
    """
    line = np.concatenate([np.append(a, np.uint8(0)) for a in arrays])[: TRAIN_CHARS + RATE_CHARS]
    cut = -(-len(line) * TRAIN_CHARS // (TRAIN_CHARS + RATE_CHARS))
    rate = line[cut:]
    return line[:cut], rate if (rate > 1).any() else line


def fit(docs: DataFrame) -> tuple[CrossParser, Reducer] | None:
    """A parser from labelled rows that aren't held out; None if there are none.

    Whole distinct texts per language are fetched in the order of their hash, TRAIN_ROWS at most and until
    they hold TRAIN_CHARS + RATE_CHARS characters; this bounded sample fits the classifier and nothing
    else.  The number of languages is assumed to be small.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rows = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND text <> ''").filter(~held)
    rows = rows.withColumn("h", F.xxhash64("text"))
    # copies teach nothing: the choice is among distinct hashes, on rows without their texts
    first = Window.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h", F.length("text").alias("size")).distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= TRAIN_ROWS)
    chosen = chosen.withColumn("before", F.sum("size").over(first) - F.col("size")).filter(F.col("before") < TRAIN_CHARS + RATE_CHARS)
    picked = rows.join(F.broadcast(chosen.select("lang", "h", "n")), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text", "n")
    by: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", "n").collect():
        by.setdefault(r["lang"], []).append(r["text"])
    counts = Counter(c for texts in by.values() for t in texts for c in t.lower() if c.isalpha() and len(c) == 1)
    alphabet = sorted(c for c, _ in counts.most_common(ALPHABET))
    if not alphabet:
        return None
    reducer, languages, tables, rates, own = Reducer(alphabet), [], [], [], []
    for lang in sorted(by):
        arrays = [a for a in map(reducer, by[lang]) if (a != 1).any()]
        if not arrays:
            continue
        symbols, own_rate = split(arrays)
        languages.append(lang)
        tables.append(automaton(symbols.tolist(), len(alphabet) + 2))
        own.append(own_rate)
    if not languages:
        return None
    parser = CrossParser(languages, alphabet, tables, [1.0] * len(languages))
    for j, array in enumerate(own):
        rates.append(max(1e-6, float(parser.rate_of([array])[0][0, j])))
    parser.rates = np.array(rates)
    return parser, reducer


def identify(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, lang; returns RESULT, a row per row of docs.

    Null texts and texts without a letter are `und` with score 0, as is every text where no labelled
    text can be learned from.  score: the winning language's own phrase rate over the text's, at most
    1.  A null doc_id counts as not held out and is never learned from.  Extra columns are ignored.
    """
    fitted = fit(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            if shared.value is None:
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                langs, scores = shared.value[0].predict(texts, shared.value[1])
            held = [False if pd.isna(i) else held_out(int(i)) for i in batch["doc_id"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": held, "lang_pred": langs, "score": scores})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, RESULT)


#: Score below which the pipeline takes a text for none of the learned languages: over three times the phrases.
FOREIGN = 0.3


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in one of the learned languages, with the columns of documents.

    Texts without a letter and texts whose score is below FOREIGN go.  The decision is made row by row
    beside the row itself, so repeated and null doc_ids are judged on their own texts.
    """
    fitted = spark.sparkContext.broadcast(fit(docs))
    names = docs.columns

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        if fitted.value is None:
            return pd.Series(np.ones(len(texts), bool))
        langs, scores = fitted.value[0].predict([t if isinstance(t, str) else None for t in texts], fitted.value[1])
        return pd.Series([g != UNKNOWN and s >= FOREIGN for g, s in zip(langs, scores.tolist())])

    return docs.filter(keeps(F.col("text"))).select(names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
