"""Token counts of every prefix of every text, by dynamic programming over the byte-pair vocabulary.

``prefix_steps`` returns for each document one signed byte a character: how much
the token count of the prefix grows (or shrinks) with that character. Their
running sum is the exact number of tokens that the library gives for each prefix,
so the token count, the longest prefix within a budget and the count of any cut
are answered from the steps, with nothing encoded again (``count_at``,
``longest_within``).

The programme. Within one piece of the split pattern, the last token of a
prefix's encoding is the one vocabulary entry ``t`` that ends the prefix and that
may stand after the last token of the prefix before ``t``; two tokens may stand
side by side if merging their joint bytes gives the two back. So each prefix
takes one step back to an earlier prefix, and its count is that prefix's plus
one. Pieces add up; a prefix that ends inside white space, inside a contraction
or inside an added token is split as the pattern splits that prefix.

Cases: null and empty texts have no steps and 0 tokens; repeated rows are kept;
further columns are ignored; an empty table gives an empty table; long texts are
taken whole (a document's steps are as many bytes as it has characters).
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable, one_by_one
from .common import kept, offsets_of, prepare

BATCH = 1000
#: Pieces remembered; cells of one table of starts and ends.
MAX_PIECES, CELLS = 300_000, 2_000_000

_tables: dict[str, ChunkTable] = {}


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Borders:
    """Which tokens may stand side by side, from the order of merges alone.

    A token grows from its bytes merge by merge. At the border of two tokens stand the last part
    of the left one and the first part of the right one; both grow in order of rank. The pair is
    cut apart by the encoder unless, at some time, the parts at the border merge with each other
    before either grows into its own token.
    """

    NEVER = 1 << 40

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.size = max(tokens.values(), default=0) + 1
        pairs = {}
        for rank, (a, b) in enumerate(merges):
            pairs.setdefault((tokens[a], tokens[b]), rank)
        keys = np.array([a * self.size + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order]
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            made.setdefault(tokens[a + b], (tokens[a], tokens[b], rank))

        def growth(side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The parts at one side of every token from its byte up, one token after another, and the rank at which each grows."""
            parts, ranks, starts = [], [], np.zeros(self.size, dtype=np.int64)
            for t in tokens.values():
                up = [(t, self.NEVER)]
                while up[-1][0] in made:
                    made_of = made[up[-1][0]]
                    up.append((made_of[side], made_of[2]))
                starts[t] = len(parts)
                parts += [x[0] for x in reversed(up)]
                ranks += [x[1] for x in reversed(up)]
            return starts, np.array(parts, dtype=np.int64), np.array(ranks, dtype=np.int64)

        self.last, self.first = growth(1), growth(0)

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.NEVER)

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of token a's bytes and then token b's bytes is these two tokens."""
        if not len(self.keys) or not len(a):
            return np.ones(len(a), dtype=bool)
        pair, place = np.unique(a * self.size + b, return_inverse=True)
        out = np.ones(len(pair), dtype=bool)
        live = np.arange(len(pair))
        i, j = self.last[0][pair // self.size], self.first[0][pair % self.size]
        while len(live):
            grow_a, grow_b = self.last[2][i], self.first[2][j]
            cross = self.merge_rank(self.last[1][i], self.first[1][j])
            # of equal ranks the leftmost merges first: a's own, then across, then b's own
            joined = (cross < grow_a) & (cross <= grow_b) & (cross < self.NEVER)
            out[live[joined]] = False
            more = ~joined & (np.minimum(grow_a, grow_b) < self.NEVER)
            step_a = grow_a <= grow_b
            i, j, live = (i + step_a)[more], (j + ~step_a)[more], live[more]
        return out[place]


class PrefixCounter:
    """Token counts of all prefixes of strings under a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, vocab: str):
        import public_tokenizers
        import regex

        with open(vocab, encoding="utf-8") as f:
            loaded = json.load(f)
        letter = _byte_of_letter()
        self.tokens = {bytes(letter[c] for c in t): i for t, i in loaded["model"]["vocab"].items()
                       if all(c in letter for c in t)}
        merges = (m.split(" ") if isinstance(m, str) else m for m in loaded["model"]["merges"])
        self.borders = Borders(self.tokens, [(bytes(letter[c] for c in a), bytes(letter[c] for c in b)) for a, b in merges])
        self.longest = max(map(len, self.tokens))
        self._spell()
        self.added = [t["content"] for t in loaded["added_tokens"]]
        self.added_at = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.contraction = regex.compile("'(?:re|ve|ll)").fullmatch
        self.space = regex.compile(r"\s+").fullmatch
        self.known: dict[str, list[int]] = {}

    def _spell(self) -> None:
        """The vocabulary as a tree of bytes: sorted keys (node, byte), the node each leads to, and the token that ends there or -1."""
        nodes: dict[bytes, int] = {b"": 0}
        for t in self.tokens:
            for k in range(1, len(t) + 1):
                nodes.setdefault(t[:k], len(nodes))
        keys = np.array([nodes[t[:-1]] * 256 + t[-1] for t in nodes if t], dtype=np.int64)
        order = np.argsort(keys)
        self.edges, self.leads = keys[order], np.array([n for t, n in nodes.items() if t], dtype=np.int64)[order]
        self.ends = np.full(len(nodes), -1, dtype=np.int64)
        for t, i in self.tokens.items():
            self.ends[nodes[t]] = i

    def _by_length(self, data: np.ndarray) -> np.ndarray:
        """Token counts after each byte of pieces of one length (rows of bytes), step by step over all of them."""
        n, length = data.shape
        last = np.full((n, length + 1), -1, dtype=np.int64)
        count = np.zeros((n, length + 1), dtype=np.int64)
        # walk the tree of bytes from every start at once; the longest token that fits ends a prefix
        begin = {}
        for start in range(length):
            rows, node = np.arange(n), np.zeros(n, dtype=np.int64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                key = node * 256 + data[rows, end - 1]
                at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                hit = self.edges[at] == key
                rows, node = rows[hit], self.leads[at[hit]]
                if not len(rows):
                    break
                token = self.ends[node]
                begin[start, end] = rows[token >= 0], token[token >= 0]
        for end in range(1, length + 1):
            for start in range(max(0, end - self.longest), end):
                rows, token = begin.get((start, end), (None, None))
                if rows is None:
                    continue
                free = last[rows, end] < 0
                rows, token = rows[free], token[free]
                if start:
                    fits = self.borders.stand(last[rows, start], token)
                    rows, token = rows[fits], token[fits]
                last[rows, end], count[rows, end] = token, count[rows, start] + 1
            if (last[:, end] < 0).any():
                raise ValueError("the vocabulary does not cover these bytes")
        return count[:, 1:]

    def learn(self, pieces: set[str]) -> None:
        """Count the prefixes of all pieces that aren't known yet, pieces of one length together."""
        if len(self.known) > MAX_PIECES:
            self.known.clear()
        by_length: dict[int, list[str]] = {}
        for p in pieces:
            if p not in self.known:
                by_length.setdefault(len(p.encode()), []).append(p)
        for length, some in by_length.items():
            step = max(1, CELLS // (length * min(length, self.longest)))
            for at in range(0, len(some), step):
                part = some[at:at + step]
                data = np.frombuffer("".join(part).encode(), dtype=np.uint8).reshape(len(part), length)
                counts = self._by_length(data)
                heads = np.ones((len(part), length), dtype=bool)
                heads[:, :-1] = data[:, 1:] & 0xC0 != 0x80  # where a character ends
                self.known.update(zip(part, (c[h].tolist() for c, h in zip(counts, heads, strict=True)), strict=True))

    def of_piece(self, piece: str) -> list[int]:
        """Token counts after each character of one piece, as one piece."""
        if piece not in self.known:
            self.learn({piece})
        return self.known[piece]

    def of_plain(self, pieces: list[str]) -> list[int]:
        """Token counts after each character of a text without added tokens, given by its pieces."""
        if len(pieces) == 1 and pieces[0][0] != "'":
            return self.of_piece(pieces[0])
        out: list[int] = []
        total = k = 0
        while k < len(pieces):
            piece = pieces[k]
            own = self.of_piece(piece)
            if k + 1 < len(pieces) and self.space(pieces[k + 1][0]) and self.space(piece):
                # a prefix that ends with the whole run takes the run as one piece, its last character too
                after = pieces[k + 1]
                run, rest = self.of_piece(piece + after[0]), self.of_piece(after)
                out += [total + c for c in run]
                total += own[-1]
                out += [total + c for c in rest[1:]]
                total += rest[-1]
                k += 2
                continue
            if len(piece) == 3 and self.contraction(piece):
                out += [total + 1, total + 1 + self.of_piece(piece[1])[-1], total + own[-1]]
            elif total:
                out += [total + c for c in own]
            else:
                out += own
            total += own[-1]
            k += 1
        return out

    def counts(self, text: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... characters, as the library counts them."""
        if self.added_at is None or not any(t in text for t in self.added):
            return self.of_plain(self.pieces.findall(text))
        out: list[int] = []
        at = total = 0
        for m in self.added_at.finditer(text):
            begun = self.of_plain(self.pieces.findall(text[at:m.end() - 1]))  # an unfinished added token is ordinary text
            before = begun[m.start() - at - 1] if m.start() > at else 0
            out += [total + c for c in begun]
            total += before + 1
            out.append(total)
            at = m.end()
        return out + [total + c for c in self.of_plain(self.pieces.findall(text[at:]))]

    def steps(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The steps of all chunks, one chunk after another, and their numbers of characters."""
        texts = chunks.to_pylist()
        odd = np.zeros(len(texts), dtype=bool)
        for t in self.added:
            odd |= pc.match_substring(chunks, t).to_numpy(zero_copy_only=False)
        pieces = [None if o else self.pieces.findall(t) for t, o in zip(texts, odd.tolist(), strict=True)]
        self.learn({p for own in pieces if own for p in own})
        flat, lens = one_by_one([self.counts(t) if own is None else self.of_plain(own) for t, own in zip(texts, pieces, strict=True)], np.int64)
        steps = np.diff(flat, prepend=0)
        heads = offsets_of(lens)[:-1][lens > 0]
        steps[heads] = flat[heads]
        return steps.astype(np.int8), lens


def step_table(vocab: str) -> ChunkTable:
    """This worker's table of chunks and their steps."""
    if vocab not in _tables:
        _tables[vocab] = ChunkTable(PrefixCounter(vocab).steps, np.int8)
    return _tables[vocab]


def count_at(steps: bytes, chars: int) -> int:
    """Tokens of the prefix of so many characters."""
    return int(np.frombuffer(steps, dtype=np.int8)[:chars].sum(dtype=np.int64))


def longest_within(steps: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def steps_of(docs: DataFrame, vocab: str) -> DataFrame:
    """doc_id, n_bytes, steps of every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)

    def count(batches):
        table = step_table(vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                text = part.column("text")
                flat, starts = table.values(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()),
                     pa.array([flat[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())],
                    ["doc_id", "n_bytes", "steps"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, steps binary")


def answers(stored: DataFrame, budget: int, keep_steps: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (and the steps) from stored steps; nothing is encoded again."""
    def answer(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                runs = [np.frombuffer(x.as_buffer(), dtype=np.int8) for x in part.column("steps")]
                starts = offsets_of(np.array(list(map(len, runs)), dtype=np.int64))
                sums = np.concatenate([[0], np.cumsum(np.concatenate([*runs, np.zeros(0, np.int8)]), dtype=np.int64)])[starts]
                n, fits = np.diff(sums), np.diff(starts)
                for k in np.flatnonzero(n > 0):  # a prefix can take more tokens than the whole text
                    if n[k] > budget or len(runs[k]) > budget and np.cumsum(runs[k], dtype=np.int64).max() > budget:
                        fits[k] = longest_within(runs[k], budget)
                cols = [part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64()), pa.array(n > budget), pa.array(fits, pa.int64())]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
                if keep_steps:
                    cols, names = [*cols, part.column("steps")], [*names, "steps"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return stored.mapInArrow(answer, schema + (", steps binary" if keep_steps else ""))


def prefix_steps(docs: DataFrame, vocab: str, budget: int, keep_steps: bool = True) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_bytes, n_tokens, over_limit, fit_chars and the steps.

    The steps are stored in the shared folder and all answers come from there. ``fit_chars`` is the
    length of the longest prefix within the budget; ``keep_steps=False`` leaves the steps out of the result.
    """
    return answers(kept(steps_of(docs, vocab), "steps"), budget, keep_steps)
