"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text (TRAIN_BYTES bytes from at most TRAIN_DOCS
documents, drawn by hash of doc_id; with many languages fewer, so that all samples have MODEL_BYTES together). A text is cut greedily into the
longest phrases that occur in the sample (longest matches in the automaton). A phrase costs as many bits as name a place in the sample, so
counts are normalised by the logarithm of the sample's length: a language of which little text is known is not held against it. The
language that needs the fewest normalised phrases wins, ties by name.

Each automaton has the bytes that its sample holds as symbols, and one symbol for all others, which is a phrase of its own. It is a table of next
states, where a step that ends a phrase is marked and goes on from the root, so a whole batch of texts is parsed side by
side, one table look-up for each byte. Texts are parsed in lanes of LANE bytes at once, each from the state in which the one before it ended: lanes that guessed another
state are parsed again, and when they are few, or after ROUNDS rounds, in turn. So counts are those of one greedy parse of the whole text.

Null text and text without letters: `und`, score 0. Labels that are null are not learned from; with no labelled text
all is `und`. The score is 1 - (phrases of the best / phrases of the second), or 1 with a single language. Repeated rows are judged each
on their own; doc_id, lang and source never reach a prediction; other columns are ignored (kept by `keep_known`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, table

TRAIN_BYTES = 24_000
TRAIN_DOCS = 48
MODEL_BYTES = 600_000
LANE = 512
#: A parse soon meets one that began elsewhere, so second rounds nearly always settle the lanes.
ROUNDS = 3
#: So few lanes are parsed sooner in turn than side by side.
FEW = 64
#: Bytes of text parsed together.
BLOCK_BYTES = 2 << 20
UNKNOWN = "und"
#: No language explains a text whose phrases have fewer bytes than this on average.
MIN_PHRASE = 1.5
#: A step's number of phrases that end stands above this bit.
ENDS = 29
#: ASCII signs and digits, which no language owns, are left out; white space is a space.
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalpha())
SPACES = bytes(32 if c < 33 or c == 127 else c for c in range(256))
LETTER = regex.compile(r"\p{L}")


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8").translate(SPACES, SIGNS)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton (online construction)."""
    to: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in symbols:
        new = len(to)
        to.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return to


def steps(symbols: list[int], width: int) -> np.ndarray:
    """Next state by state * width + symbol, and from bit ENDS on how many phrases end there."""
    to = automaton(symbols)
    root = np.zeros(width, np.int32)
    for c, s in to[0].items():
        root[c] = s
    # a phrase ends where it can't go on; a symbol that isn't in the sample is one more, of its own
    out = np.tile(root | (1 + (root == 0)) << ENDS, (len(to), 1)).astype(np.int32)
    out[0] = root | (root == 0) << ENDS
    flat = [(i, c, s) for i, t in enumerate(to) for c, s in t.items()]
    at = np.array(flat, np.int64)
    if len(at):
        out[at[:, 0], at[:, 1]] = at[:, 2]
    return out.ravel()


class Parser:
    """Phrases for each text and language."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        self.symbols, self.widths, self.tables = [], [], []
        for name in self.names:
            data = np.frombuffer(samples[name], "u1")
            own = np.unique(data)
            symbol = np.full(256, len(own), np.uint8 if len(own) < 256 else np.uint16)
            symbol[own] = np.arange(len(own))
            self.symbols.append(symbol)
            self.widths.append(len(own) + 1)
            self.tables.append(steps(symbol[data].tolist(), len(own) + 1))
        self.bits = np.array([np.log2(len(samples[n]) + 2) for n in self.names])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """An array of texts by languages."""
        n = np.array([len(t) for t in texts], np.int64)
        lanes = -(-n // LANE)
        total = int(lanes.sum())
        found = np.zeros((len(texts), len(self.names)), np.int64)
        if not total:
            return found
        owner = np.repeat(np.arange(len(texts)), lanes)
        first = np.concatenate([[0], np.cumsum(lanes)[:-1]])
        grid = np.zeros(total * LANE, "u1")
        held = np.full(total, LANE, np.int64)
        for t, f, k, size in zip(texts, first, lanes, n, strict=True):
            grid[f * LANE : f * LANE + size] = np.frombuffer(t, "u1")
            if k:
                held[f + k - 1] = size - (k - 1) * LANE
        grid, begins = grid.reshape(total, LANE), np.concatenate([[True], owner[1:] != owner[:-1]])
        for k in range(len(self.names)):
            entry, left, count = (np.zeros(total, np.int32) for _ in range(3))
            todo, rounds = np.arange(total), 0
            while len(todo) > FEW and rounds < ROUNDS or not rounds:
                left[todo], count[todo] = self.side_by_side(k, grid[todo], held[todo], entry[todo])
                true, rounds = np.where(begins, 0, np.roll(left, 1)), rounds + 1
                todo = np.flatnonzero(true != entry)
                entry[todo] = true[todo]
            if len(todo):
                self.in_turn(k, grid, held, begins, todo, entry, left, count)
            ends = np.roll(begins, -1)  # a phrase that the end of a text cuts off counts
            np.add.at(found[:, k], owner, count + (ends & (left > 0)))
        return found

    def side_by_side(self, k: int, grid: np.ndarray, held: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after each lane and the phrases that end in it."""
        symbol, width, next_state = self.symbols[k], np.int32(self.widths[k]), self.tables[k]
        # longest lanes first, so that those still running are a prefix
        order = np.argsort(-held, kind="stable")
        cols = np.ascontiguousarray(grid[order].T)
        running = np.searchsorted(-held[order], -np.arange(LANE), side="left")
        state, count = entry[order], np.zeros(len(order), np.int32)
        for i in range(LANE):
            m = int(running[i])
            if not m:
                break
            v = next_state[state[:m] * width + symbol[cols[i, :m]]]
            count[:m] += v >> ENDS
            state[:m] = v & ((1 << ENDS) - 1)
        back = np.argsort(order, kind="stable")
        return state[back], count[back]

    def in_turn(self, k: int, grid: np.ndarray, held: np.ndarray, begins: np.ndarray, todo: np.ndarray, entry: np.ndarray, left: np.ndarray, count: np.ndarray) -> None:
        """Lanes whose state did not settle, one after the other; entry, left and count are set."""
        width, next_state, rest, stale = self.widths[k], memoryview(self.tables[k]), (1 << ENDS) - 1, set(todo.tolist())
        for j in range(int(todo[0]), len(held)):
            state = 0 if begins[j] else int(left[j - 1])
            if j in stale or state != entry[j]:
                entry[j], ended = state, 0
                for c in self.symbols[k][grid[j, : held[j]]].tolist():
                    v = next_state[state * width + c]
                    ended += v >> ENDS
                    state = v & rest
                left[j], count[j] = state, ended


def predict(parser: Parser, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, score and bytes for each phrase of it, of each text."""
    names, scores, lengths = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    asked = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    at = 0
    while at < len(asked) and parser.names:
        block, held = [], 0
        while at + len(block) < len(asked) and (not block or held < BLOCK_BYTES):
            block.append(plain(texts[asked[at + len(block)]]))
            held += len(block[-1])
        counts = parser.phrases(block)
        found = counts * parser.bits
        best = found.argmin(axis=1)
        rest = np.sort(found, axis=1)[:, 1] if len(parser.names) > 1 else np.full(len(block), np.inf)
        for j, (i, k) in enumerate(zip(asked[at : at + len(block)], best.tolist(), strict=True)):
            names[i] = parser.names[k]
            scores[i] = float(1 - found[j, k] / rest[j])
            lengths[i] = len(block[j]) / max(1, int(counts[j, k]))
        at += len(block)
    return names, scores, lengths


def fit(docs: DataFrame, train_bytes: int = TRAIN_BYTES, train_docs: int = TRAIN_DOCS) -> Parser:
    """Learns from text and lang of documents that aren't held out: about train_docs for each language, drawn by hash."""
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40))
    wanted = F.lit(False)
    for lang, n in counts.items():  # twice as many as needed, so that there are enough
        wanted |= (F.col("lang") == lang) & (draw < int(min(1.0, (2 * train_docs + 20) / n) * (1 << 40)))
    drawn: dict[str, list] = {lang: [] for lang in counts}
    for r in usable.filter(wanted).select("lang", draw.alias("draw"), F.substring("text", 1, train_bytes).alias("text")).collect():
        drawn[r.lang].append((r.draw, r.text))
    train_bytes = min(train_bytes, MODEL_BYTES // max(1, len(counts)))
    samples = {}
    for lang, rows in drawn.items():
        parts = [plain(text) for _, text in sorted(rows)[:train_docs]]
        each = max(1, train_bytes // max(1, len(parts)))
        sample = b" ".join(p[:each] for p in parts)
        left = b" ".join(p[each:] for p in parts)  # short documents leave room
        samples[lang] = (sample + b" " + left)[:train_bytes]
    return Parser(samples)


def identify(docs: DataFrame, parser: Parser, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns of docs with lang_pred, score and phrase_bytes."""
    judged = judge(docs, parser, columns)
    return judged.select("kept.*", "lang_pred", "score", "phrase_bytes")


def judge(docs: DataFrame, parser: Parser, columns: tuple[str, ...]) -> DataFrame:
    """kept (a struct of columns of docs), lang_pred, score and phrase_bytes."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in columns)).alias("kept"), "text")

    def run(batches):
        for b in batches:
            names, scores, lengths = predict(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(lengths, pa.float64())], ["kept", "lang_pred", "score", "phrase_bytes"])

    schema = StructType([rows.schema["kept"]]).add("lang_pred", "string").add("score", "double").add("phrase_bytes", "double")
    return rows.mapInArrow(run, schema)


def keep_known(docs: DataFrame) -> DataFrame:
    """docs with the language found in `lang`, without those that have no letters. Texts that no language explains (phrases under MIN_PHRASE bytes on average, as in a
    script that nobody labelled) stay, as `und`, whatever their size and label. Where there is nothing to learn from, only letters count and `lang` stays."""
    parser = fit(docs)
    if not parser.names:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    known = judge(docs, parser, tuple(docs.columns)).filter(F.col("lang_pred") != UNKNOWN)
    lang = F.when(F.col("phrase_bytes") >= MIN_PHRASE, F.col("lang_pred")).otherwise(F.lit(UNKNOWN))
    return known.select(*(lang.alias("lang") if n == "lang" else F.col(f"kept.`{n}`").alias(n) for n in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return identify(marked, fit(docs), ("doc_id", "held_out"))
