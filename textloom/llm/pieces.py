"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all pieces. It runs over a text once; at each position its output links name the pieces that end there, longest first,
and each relaxes the position's best score from the one where it starts. A character that is no piece costs ``UNKNOWN_PENALTY`` less than the
worst piece and is written as byte pieces. The path of the best sum of scores wins, ties to the longer last piece: the unigram rule, also
for a model whose scores are merge ranks (then the result may differ from merging pairs).

No piece has a blank after another character, so the best path of a text is that of its units (blanks and what follows them), and the
units' paths are remembered (``REMEMBERED`` at most). Units of more than ``LONGEST_REMEMBERED`` characters, as scripts without blanks have them, are cut
further between two characters that are neighbours in no piece: no piece spans such a place, so the paths stay the best ones. Units that are new
in a batch step through the automaton side by side; of those that stay long, few at a time, or one alone. A literal U+2581, which the
models use for the blank, is written as bytes, so that decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, tidied

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
#: Positions of units that step side by side (20 bytes each), and the fewest long units for which that pays.
CELLS, FEWEST = 1 << 20, 12
BLANK = "▁"
_UNITS = re.compile(" +[^ ]*")


@lru_cache(maxsize=4)
def read_model(path: str) -> tuple:
    """((piece, score, kind), ..) with kind n(ormal), b(yte) or c(ontrol), from a model file that the driver can open."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "b" if sp.is_byte(i) else "c" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "n"
    return tuple((sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size()))


class Codec:
    """Encoder and decoder for a list of pieces.

    The automaton is kept as arrays so that many units step through it at once: ``delta`` (rows of inner states, a column for each character
    of the longer pieces; column 0 is any other character and leads to the root), ``first`` (the longest piece that ends in a state) and
    ``link`` (the next shorter one).
    """

    def __init__(self, pieces: tuple):
        self.bytes_of = [b""] * len(pieces)
        self.byte_id = [0] * 256
        least, words = 0.0, []
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == "b":
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif kind == "n":
                if re.search(f"[^{BLANK}]{BLANK}", piece):
                    raise ValueError(f"piece {piece!r} has a blank inside; texts cannot be cut at blanks")
                words.append((piece, i, score))
                self.bytes_of[i] = piece.replace(BLANK, " ").encode()
                least = min(least, score)
        self.unknown = least - UNKNOWN_PENALTY
        self.single = {p: (i, score) for p, i, score in words if len(p) == 1}
        self.columns = {c: k for k, c in enumerate(sorted({c for p, _, _ in words if len(p) > 1 for c in p}), 1)}
        self._build(words)
        pairs = {self.columns[a] * len(self.columns) + self.columns[b] for p, _, _ in words for a, b in zip(p, p[1:], strict=False)}
        self.pairs = np.array(sorted(pairs | {-1}), np.int64)  # characters that are neighbours in some piece
        self.lists: tuple = ()
        self.known: dict[str, bytes] = {}
        self.chars: dict[int, tuple[int, int, float]] = {}

    def _build(self, words: list) -> None:
        kids: list[dict[int, int]] = [{}]
        piece, gain, size = [-1], [0.0], [0]
        for p, i, score in words:
            if any(c not in self.columns for c in p):
                continue  # a character of its own: see ``single``
            at = 0
            for c in p:
                k = self.columns[c]
                if k not in kids[at]:
                    kids[at][k] = len(kids)
                    kids.append({})
                    piece.append(-1)
                    gain.append(0.0)
                    size.append(0)
                at = kids[at][k]
            piece[at], gain[at], size[at] = i, score, len(p)
        n = len(kids)
        inner = [s for s in range(n) if kids[s] or s == 0]
        row = np.zeros(n, np.int32)
        row[inner] = np.arange(len(inner))
        delta = np.zeros((len(inner), len(self.columns) + 1), np.int32)
        fail, link = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        for k, t in kids[0].items():
            delta[0, k] = t
        level = list(kids[0].values())
        while level:
            deeper = []
            for s in level:
                f = fail[s]
                link[s] = f if piece[f] >= 0 else link[f]
                if kids[s]:
                    delta[row[s]] = delta[row[f]]
                    for k, t in kids[s].items():
                        fail[t] = delta[row[f], k]
                        delta[row[s], k] = t
                    deeper += kids[s].values()
                else:
                    row[s] = row[f]
            level = deeper
        self.delta, self.row, self.link = delta, row, link
        self.piece, self.gain, self.size = np.array(piece, np.int32), np.array(gain), np.array(size, np.int32)
        self.first = np.where(self.piece >= 0, np.arange(n, dtype=np.int32), link)

    def _char(self, code: int) -> tuple[int, int, float]:
        """(column, piece of its own or -1, its score) of a code point; the piece only for characters outside the automaton, -2 if inside."""
        c = chr(code)
        i, score = self.single.get(c, (-1, self.unknown))
        col = self.columns.get(c, 0)
        self.chars[code] = got = (col, -2 if col and i >= 0 else i, score)
        return got

    def viterbi(self, units: list[str]) -> list[bytes]:
        """int32 ids, as bytes, of the best path over each unit: one pass over the positions, all units side by side."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        n, most = len(units), int(lengths[0])
        flat = np.frombuffer("".join([units[u] for u in order.tolist()]).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes, at = np.unique(flat, return_inverse=True)
        about = [self.chars.get(c) or self._char(c) for c in codes.tolist()]
        col, own, score1 = np.array([a[0] for a in about], np.int32), np.array([a[1] for a in about], np.int32), np.array([a[2] for a in about])
        grid = np.zeros((n, most), np.int32)
        grid[np.arange(most)[None, :] < lengths[:, None]] = at
        score = np.zeros((n, most + 1))
        back, took = np.zeros((n, most + 1), np.int32), np.ones((n, most + 1), np.int32)
        state = np.zeros(n, np.int32)
        for e in range(most):
            live = int(np.searchsorted(-lengths, -e, "left"))
            g = grid[:live, e]
            state = self.delta[self.row[state[:live]], col[g]]
            best, step, size = np.full(live, -np.inf), np.full(live, -1, np.int32), np.ones(live, np.int32)
            cur = self.first[state]
            u = np.flatnonzero(cur >= 0)
            s = cur[u]
            while len(u):
                c = score[u, e + 1 - self.size[s]] + self.gain[s]
                better = c > best[u]
                v, t = u[better], s[better]
                best[v], step[v], size[v] = c[better], self.piece[t], self.size[t]
                s = self.link[s]
                u, s = u[s >= 0], s[s >= 0]
            lone = own[g]
            c = score[:live, e] + score1[g]
            v = np.flatnonzero((lone > -2) & (c > best))
            best[v], step[v], size[v] = c[v], lone[v], 1
            score[:live, e + 1], back[:live, e + 1], took[:live, e + 1] = best, step, size
        ids = np.zeros((n, most), np.int32)
        head, pos = np.full(n, most), lengths.copy()
        u = np.arange(n)
        while len(u):
            head[u] -= 1
            ids[u, head[u]] = back[u, pos[u]]
            pos[u] -= took[u, pos[u]]
            u = u[pos[u] > 0]
        raw, out = ids.tobytes(), [b""] * n
        lost = set(np.flatnonzero((ids < 0).any(axis=1)).tolist())
        for k, (u, h) in enumerate(zip(order.tolist(), head.tolist(), strict=True)):
            out[u] = self._spelled(units[u].replace(" ", BLANK), ids[k, h:].tolist()) if k in lost else raw[4 * (k * most + h) : 4 * (k + 1) * most]
        return out

    def viterbi_one(self, unit: str) -> bytes:
        """``viterbi`` of one long unit, in plain Python: a step a character without the cost of array calls."""
        text = unit.replace(" ", BLANK)
        if not self.lists:
            self.lists = tuple(x.tolist() for x in (self.row, self.first, self.link, self.piece, self.gain, self.size))
        row, first, link, piece, gain, size = self.lists
        after, about = self.delta.item, self.chars.get
        score, back, took = [0.0], [0], [1]
        state = 0
        for e, c in enumerate(map(ord, text)):
            col, own, lone = about(c) or self._char(c)
            state = after(row[state], col)
            best, step, length = -np.inf, -1, 1
            s = first[state]
            while s >= 0:
                v = score[e + 1 - size[s]] + gain[s]
                if v > best:
                    best, step, length = v, piece[s], size[s]
                s = link[s]
            if own > -2 and score[e] + lone > best:
                best, step, length = score[e] + lone, own, 1
            score.append(best)
            back.append(step)
            took.append(length)
        ids, at = [], len(text)
        while at:
            ids.append(back[at])
            at -= took[at]
        ids.reverse()
        return self._spelled(text, ids) if -1 in ids else np.array(ids, np.int32).tobytes()

    def _cut(self, unit: str) -> list[str]:
        """A long unit in parts that no piece spans."""
        codes, at = np.unique(np.frombuffer(unit.replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        col = np.array([(self.chars.get(c) or self._char(c))[0] for c in codes.tolist()], np.int64)[at]
        key = np.where((col[:-1] > 0) & (col[1:] > 0), col[:-1] * len(self.columns) + col[1:], -2)
        near = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
        ends = [0, *(np.flatnonzero(~near) + 1).tolist(), len(unit)]
        return [unit[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _spelled(self, unit: str, ids: list[int]) -> bytes:
        """A path on which characters that are no piece become byte pieces."""
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.bytes_of[i].decode())
            else:
                out += [self.byte_id[b] for b in unit[at].encode("utf-8", "surrogatepass")]
                at += 1
        return np.array(out, np.int32).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """int32 ids of each text; none for null and empty ones. New units of all texts go through the automaton together."""
        cut = []
        for t in texts:
            parts = []
            for part in (" " + t).split(BLANK) if t else ():
                units = _UNITS.findall(part)
                start = part.find(" ")
                units = [part[:start] if start >= 0 else part, *units] if start and part else units
                if max(map(len, units), default=0) > LONGEST_REMEMBERED:
                    units = [x for u in units for x in (self._cut(u) if len(u) > LONGEST_REMEMBERED else (u,))]
                parts.append(units)
            cut.append(parts)
        needed = set(chain.from_iterable(chain.from_iterable(cut)))
        new = sorted(needed - self.known.keys(), key=len)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {u: self.known[u] for u in needed if u in self.known}
        at = bisect(new, LONGEST_REMEMBERED, key=len)
        for lo in range(0, at, 8192):
            self.known.update(zip(new[lo : min(at, lo + 8192)], self.viterbi(new[lo : min(at, lo + 8192)]), strict=True))
        hi = len(new)
        while hi > at:  # the longest first
            lo = max(at, hi - max(1, CELLS // len(new[hi - 1])))
            self.known.update(zip(new[lo:hi], self.viterbi(new[lo:hi]) if hi - lo >= FEWEST else map(self.viterbi_one, new[lo:hi]), strict=True))
            hi = lo
        literal = np.array([self.byte_id[b] for b in BLANK.encode()], np.int32).tobytes()
        get = self.known.__getitem__
        out = [np.frombuffer(literal.join([b"".join(map(get, units)) for units in parts]), np.int32) for parts in cut]
        for u in new[at:]:
            del self.known[u]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of ids; the blank put before every text is dropped."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def _codec(model: str, pieces) -> Codec:
    """One codec of a model in each Python worker."""
    if model not in _CODECS:
        _CODECS.clear()
        _CODECS[model] = Codec(pieces.value)
    return _CODECS[model]


def _forget() -> None:
    """At the end of a task: the remembered units go if they are many."""
    for c in _CODECS.values():
        if len(c.known) > REMEMBERED // 4:
            c.known = {}


def _fields(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + list(more))


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with array<int> ids of the whole text; null and empty texts give an empty array. A column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(ids_col)
    at = docs.columns.index(text_col)
    pieces = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, pieces)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = codec.encode_all(part.column(at).to_pylist())
                offsets = np.cumsum([0, *map(len, got)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, ids_col])

    return docs.mapInArrow(tidied(run, _forget), _fields(docs, f"`{ids_col}` array<int>"))


def decode(rows: DataFrame, model: str = MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the string that the ids stand for; null ids give an empty one. A column of that name is replaced."""
    rows = rows.drop(out_col)
    at = rows.columns.index(ids_col)
    pieces = rows.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, pieces)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = pa.array([codec.decode(x.values.to_pylist() if x.is_valid else []) for x in part.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, out_col])

    return rows.mapInArrow(tidied(run), _fields(rows, f"`{out_col}` string"))


def with_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, text_sha256, decoded_sha256, exact: encoding, and whether decoding gives the text back, a row for each of ``docs``.

    Null texts count as empty and have no ids; repeated rows and null ids stay as they are; of equally good paths that with the longer last
    piece is taken, at each place. Other columns are not read, whatever they are called; an empty table gives no rows. Both ways run in one Python stage, so that a task has one worker
    and one automaton.
    """
    bounded_batches(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(read_model(model))
    rows = docs.select("doc_id", "text", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, pieces)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = codec.encode_all(part.column(1).to_pylist())
                back = [hashlib.sha256(codec.decode(x.tolist()).encode("utf-8", "surrogatepass")).hexdigest() for x in got]
                offsets = np.cumsum([0, *map(len, got)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), ids, pa.array(back, pa.string())], ["doc_id", "text_sha256", "ids", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    back = rows.mapInArrow(tidied(run, _forget), f"doc_id {kind}, text_sha256 string, ids array<int>, decoded_sha256 string")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text_sha256", "decoded_sha256", (F.col("text_sha256") == F.col("decoded_sha256")).alias("exact"))
