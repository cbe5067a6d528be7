"""N-best segmentation into the pieces of a SentencePiece model, and decoding."""

from __future__ import annotations

import heapq
import itertools
import math
import re
import struct
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table

#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: The model type, in a model file's trainer settings, whose scores are ranks.
BYTE_PAIR = 2
#: Scores are held as whole numbers of this many a nat, less 1 for each piece, so that sums are exact, and of equals the one with fewer pieces comes first.
UNIT = 1 << 30
#: An unknown character costs this much more than the worst piece.
PENALTY = 10 * UNIT - 1
#: A byte-pair model scores its pieces by merge rank, negated. Their log-probabilities follow the Zipf-Mandelbrot law with this offset: -ln(rank + OFFSET).
OFFSET = 500
BLANK = "▁"
#: Parts of texts that can be cut apart: no piece holds a blank after another character, or a line end.
PARTS = re.compile(r" +[^ \n]*|\n|[^ \n]+")
#: Parts of texts whose segmentations a worker holds, and ids in them; parts of more than LONG characters are searched one by one.
HELD, HELD_IDS, LONG = 300_000, 8_000_000, 40
#: Positions of a long part whose arcs are found together.
WINDOW = 4096
#: Parts whose n best segmentations a worker holds.
CHOSEN = 50_000
#: The loss of a second segmentation where there is none, and the score of what is no piece.
NONE, NO = 1 << 58, -(1 << 60)
#: Texts whose parts are learned together.
TEXTS = 512
#: Of the polynomial hash of pieces.
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
#: First bits of a hash that lead to the pieces with such hashes.
HEAD = 17


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: number and value."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(message):
        key, i = varint(i)
        match key & 7:
            case 0:
                value, i = varint(i)
            case 1:
                value, i = message[i : i + 8], i + 8
            case 5:
                (value,), i = struct.unpack("<f", message[i : i + 4]), i + 4
            case _:
                n, i = varint(i)
                value, i = message[i : i + n], i + n
        yield key >> 3, value


class Choice(NamedTuple):
    """A segmentation: the sum of its pieces' scores, and their ids."""

    score: int
    ids: array


class NBest(NamedTuple):
    """The n best segmentations of each of several texts: ids[ends[i] : ends[i + 1]] and scores[i] are the best of text i. others[i] has the others, best first:
    their scores, and edits to the best: (index of an id, how many ids go, the ids that come)."""

    ids: np.ndarray
    ends: np.ndarray
    scores: list[int]
    others: list[list[tuple[int, list[tuple[int, int, array]]]]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], and on for lengths[0] numbers; starts[1], and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Lattice:
    """The pieces of a model with their scores, and searches in the lattice of a text."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for k, v in message if k == 1]
        by_rank = any(dict(_fields(v)).get(3) == BYTE_PAIR for k, v in message if k == 2)
        kinds = [p.get(3, NORMAL) for p in pieces]
        names = [p[1].decode() for p in pieces]
        nats = [-math.log(OFFSET - p.get(2, 0.0)) if by_rank else p.get(2, 0.0) for p in pieces]
        self.scores = [round(x * UNIT / 64) * 64 - 1 for x in nats]
        self.ids = {n.replace(BLANK, " "): i for i, (n, k) in enumerate(zip(names, kinds)) if k in (NORMAL, USER)}
        self.byte_ids = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds)) if k == BYTE}
        if len(self.byte_ids) != 256 or any(re.search(r"[^ ] |\n", n) for n in self.ids):
            raise ValueError("a model with pieces for all bytes is needed, and without pieces that hold line ends or inner blanks")
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores) - PENALTY
        self.bytes = [b"" if k in (UNKNOWN, CONTROL) else bytes([int(n[3:5], 16)]) if k == BYTE else n.replace(BLANK, " ").encode() for n, k in zip(names, kinds)]
        #: The pieces by a polynomial hash of their characters, for lookups of many at once.
        hashes = np.array([self._hash(n) for n in self.ids], np.uint64) * np.uint64(MIX)
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array(list(self.ids.values()))[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have the same hash")
        #: Where the hashes with the same first bits begin, and how many there are at most.
        heads = (self.hashes >> np.uint64(64 - HEAD)).astype(np.int64)
        self.begin = np.searchsorted(heads, np.arange(1 << HEAD)).astype(np.int32)
        self.depth = int(np.bincount(heads).max())
        self.hashes, self.hash_ids = np.r_[self.hashes, np.zeros(self.depth, np.uint64)], np.r_[self.hash_ids, np.full(self.depth, -1)]
        self.heads = np.r_[np.bincount(heads, minlength=1 << HEAD)].astype(np.int8)
        #: By id; the last is for no piece.
        self.score_of = np.array([*self.scores, NO])
        lengths = np.array(list(map(len, self.bytes)))
        self.byte_at, self.byte_length = np.r_[0, np.cumsum(lengths)[:-1]], lengths
        self.all_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.reset()

    def reset(self) -> None:
        """Forget all parts."""
        self.held: dict[str, int] = {}
        self.chosen: dict[str, list[Choice]] = {}
        #: Of each part held: where its best segmentation lies in flat, and its length; its score; how much less the second scores.
        self.at, self.length, self.total, self.loss = (np.empty(0, np.int64) for _ in range(4))
        self.flat = np.empty(0, np.int32)

    def ending(self, part: str, end: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """The pieces that end at a position, the longest first: where they begin, their scores and ids. A character that is no piece gives its bytes."""
        ids, scores = self.ids, self.scores
        here = [(at, scores[i], (i,)) for at in range(max(0, end - self.longest), end) if (i := ids.get(part[at:end])) is not None]
        if not here or here[-1][0] != end - 1:
            here.append((end - 1, self.unknown, tuple(self.byte_ids[b] for b in part[end - 1].encode())))
        return here

    def arcs(self, part: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """ending() for each position."""
        return [[], *(self.ending(part, end) for end in range(1, len(part) + 1))]

    def _window(self, part: str, lo: int) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """ending() for the WINDOW positions after lo."""
        first, hi = max(0, lo - self.longest), min(len(part), lo + WINDOW)
        chars = np.frombuffer(part[first:hi].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        # hashes of all runs of 1, 2, ... characters that end at each position
        run, shape = np.zeros(len(chars), np.uint64), (self.longest, hi - lo)
        found, power = np.full(shape, -1), 1
        for length in range(1, min(self.longest, len(chars)) + 1):
            run[length - 1 :] += chars[: len(chars) - length + 1] * np.uint64(power)
            power = power * BASE % (1 << 64)
            ends = np.arange(max(lo, first + length - 1), hi)
            found[length - 1, ends - lo] = self._ids(run[ends - first])
        out: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(hi - lo)]
        at, shorter = np.nonzero(found[::-1].T >= 0)
        ids = found[::-1].T[at, shorter]
        for i, start, score, id in zip(at.tolist(), (lo + at + 1 - (self.longest - shorter)).tolist(), self.score_of[ids].tolist(), ids.tolist()):
            out[i].append((start, score, (id,)))
        for i in np.flatnonzero(found[0] < 0).tolist():
            out[i].append((lo + i, self.unknown, tuple(self.byte_ids[b] for b in part[lo + i].encode("utf-8", "surrogatepass"))))
        return out

    def search(self, part: str, n: int) -> list[Choice]:
        """The n best segmentations of a part, best first.

        Viterbi scores from the start are the exact remaining scores of a search that runs backward from the end, so it pops
        hypotheses in the order of their whole scores. Each hypothesis on the agenda stands for a segmentation of its own of exactly its score, so the agenda holds no more
        of them than are still asked for, and memory grows with the part by its scores and the n lists of ids alone. Ties go to the one that was reached first,
        where longer last pieces are reached before shorter.
        """
        windows: dict[int, list[list[tuple[int, int, tuple[int, ...]]]]] = {}

        def far(end: int) -> list[tuple[int, int, tuple[int, ...]]]:
            k, i = divmod(end - 1, WINDOW)
            if k not in windows:
                if len(windows) == 4:
                    del windows[next(iter(windows))]
                windows[k] = self._window(part, k * WINDOW)
            return windows[k][i]

        arcs = self.arcs(part).__getitem__ if len(part) <= LONG else far
        best = array("q", [0])
        for end in range(1, len(part) + 1):
            best.append(max([best[at] + score for at, score, _ in arcs(end)]))
        #: (score, order, position, score behind, ids behind in a list that others share, how many of them count, the last piece)
        agenda = [(-best[-1], 0, len(part), 0, array("i"), 0, ())]
        found: list[Choice] = []
        order = 0
        while agenda:
            _, _, at, behind, ids, length, last = agenda.pop(0)
            if len(ids) != length:
                ids = ids[:length]
            ids.extend(last[::-1])
            if at == 0:
                found.append(Choice(behind, ids[::-1]))  # a copy: others may share the list
                if len(found) == n:
                    break
                continue
            length, room = len(ids), n - len(found)
            for start, score, piece in arcs(at):
                order += 1
                score += behind
                whole = -(best[start] + score)
                if len(agenda) < room or whole < agenda[-1][0]:
                    insort(agenda, (whole, order, start, score, ids, length, piece))
                    del agenda[room:]
        return found

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * BASE + ord(c) + 1) % (1 << 64)  # 1 more, or leading zeros would not count
        return h

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 where there is none."""
        hashes = hashes.ravel() * np.uint64(MIX)
        head = hashes >> np.uint64(64 - HEAD)
        out = np.full(hashes.shape, -1)
        some = np.flatnonzero(self.heads[head])
        many, begin, wanted = self.heads[head[some]], self.begin[head[some]], hashes[some]
        for step in range(self.depth):
            hit = self.hashes[begin + step] == wanted
            out[some[hit]] = self.hash_ids[begin[hit] + step]
            rest = np.flatnonzero(~hit & (many > step + 1))
            some, many, begin, wanted = some[rest], many[rest], begin[rest], wanted[rest]
        return out

    def learn(self, parts: list[str], n: int = 2) -> None:
        """Hold the best segmentation of each part, its score, and how much less the second scores: by forward Viterbi over all short parts of a length at once."""
        by_length: dict[int, list[str]] = {}
        for p in parts:
            by_length.setdefault(len(p) if len(p) <= LONG else LONG + 1, []).append(p)
        at, length, total, loss, flat, used = [self.at], [self.length], [self.total], [self.loss], [self.flat], len(self.flat)
        for size, some in sorted(by_length.items()):
            for i in range(0, len(some), 4096):
                names = some[i : i + 4096]
                ids, lengths, totals, losses = self._learn(size, names) if size <= LONG else self._first(names, n)
                self.held.update(zip(names, range(len(self.held), len(self.held) + len(names))))
                at.append(used + np.cumsum(lengths) - lengths)
                used += len(ids)
                for to, x in ((length, lengths), (total, totals), (loss, losses), (flat, ids)):
                    to.append(x)
        self.at, self.length, self.total, self.loss, self.flat = map(np.concatenate, (at, length, total, loss, flat))

    def _first(self, parts: list[str], n: int) -> tuple[np.ndarray, ...]:
        """As _learn, by search, for parts of any lengths. Their n best stay chosen."""
        for p in parts:
            self.chosen[p] = self.search(p, max(2, n))
        best = [self.chosen[p] for p in parts]
        ids = np.concatenate([np.frombuffer(c[0].ids, np.int32) for c in best])
        return ids, np.array([len(c[0].ids) for c in best]), np.array([c[0].score for c in best]), np.array([c[0].score - c[1].score if len(c) > 1 else NONE for c in best])

    def _learn(self, length: int, parts: list[str]) -> tuple[np.ndarray, ...]:
        """Of parts of a length: the ids of their best segmentations, one after the other, how many each has, their scores, and how much less the second ones score."""
        n = len(parts)
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length).astype(np.uint64)
        prefix = np.zeros((length + 1, n), np.uint64)
        power = np.ones(length + 1, np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * np.uint64(BASE) + chars[:, i] + np.uint64(1)
            power[i + 1] = int(power[i]) * BASE % (1 << 64)
        one, two = np.full((length + 1, n), NO), np.full((length + 1, n), NO)
        one[0] = 0
        back, piece = np.zeros((length + 1, n), np.int64), np.full((length + 1, n), -1)
        column = np.arange(n)
        for end in range(1, length + 1):
            starts = np.arange(max(0, end - self.longest), end)
            ids = self._ids(prefix[end] - prefix[starts] * power[end - starts][:, None]).reshape(len(starts), n)
            score = self.score_of[ids]
            score[-1, ids[-1] < 0] = self.unknown
            through = one[starts] + score
            best = through.argmax(axis=0)  # the first of equals is the longest
            one[end], back[end], piece[end] = through[best, column], starts[best], ids[best, column]
            second = two[starts[best], column] + score[best, column]
            through[best, column] = NO
            two[end] = np.maximum(np.maximum(second, through.max(axis=0)), NO)
        # back along all best paths at once; the pieces of step i are i-th from the end
        steps, at = [], np.full(n, length)
        while at.any():
            own = piece[at, column]
            steps.append(np.where(at > 0, own, -2))
            for i in np.flatnonzero((at > 0) & (own < 0)):
                steps[-1][i] = -3 - int(chars[i, at[i] - 1])
            at = back[at, column]
        path = np.stack(steps[::-1], axis=1)
        ids, row = path[path != -2], np.nonzero(path != -2)[0]
        lengths = np.bincount(row, minlength=n)
        if (ids < 0).any():  # characters that are no pieces
            spelled = [[i] if i >= 0 else [self.byte_ids[b] for b in chr(-3 - i).encode("utf-8", "surrogatepass")] for i in ids.tolist()]
            lengths = np.bincount(np.repeat(row, list(map(len, spelled))), minlength=n)
            ids = np.array(list(itertools.chain.from_iterable(spelled)))
        return ids.astype(np.int32), lengths, one[length], np.minimum(one[length] - two[length], NONE)

    def best(self, part: str) -> Choice:
        """The best segmentation of a part that is held."""
        i = self.held[part]
        return Choice(int(self.total[i]), array("i", self.flat[self.at[i] : self.at[i] + self.length[i]].tobytes()))

    def choices(self, part: str, n: int) -> list[Choice]:
        """search(), held."""
        found = self.chosen.get(part)
        if found is None or len(found) < n and len(found) == 2:
            if len(self.chosen) >= CHOSEN:
                self.chosen.clear()
            found = self.chosen[part] = self.search(part, n)
        return found[:n]

    def nbest(self, text: str, n: int) -> list[tuple[int, list[tuple[int, int, array]]]]:
        """The n best segmentations of a text: the first by its score and one edit (0, 0, all its ids); the others by their scores and edits to the first:
        (index of an id, how many ids go, the ids that come). An empty text has one, without ids."""
        found = self.nbest_of([text], n)
        return [(found.scores[0], [(0, 0, array("i", found.ids.tobytes()))]), *found.others[0]]

    def nbest_of(self, texts: list[str | None], n: int) -> NBest:
        """The n best segmentations of each text; their parts are learned together."""
        if len(self.held) > HELD or len(self.flat) > HELD_IDS:
            self.reset()
        split = [PARTS.findall(" " + t) if t else [] for t in texts]
        names = list(itertools.chain.from_iterable(split))
        if new := set(names).difference(self.held):
            self.learn(list(new), n)
        number = np.fromiter(map(self.held.__getitem__, names), np.int64, len(names))
        bounds = np.cumsum([0, *map(len, split)])
        lengths = self.length[number]
        begin = np.r_[0, np.cumsum(lengths)]
        totals = np.r_[0, np.cumsum(self.total[number])][bounds]
        losses = self.loss[number]
        others = [self._others(names, losses, lengths, begin, lo, hi, int(total), n) for lo, hi, total in zip(bounds.tolist(), bounds[1:].tolist(), np.diff(totals))]
        return NBest(self.flat[ranges(self.at[number], lengths)], begin[bounds], np.diff(totals).tolist(), others)

    def _others(self, names: list[str], losses: np.ndarray, lengths: np.ndarray, begin: np.ndarray, lo: int, hi: int, total: int, n: int) -> list[tuple[int, list[tuple[int, int, array]]]]:
        """The second to the n-th best segmentation of the text whose parts are names[lo:hi]."""
        if n == 1 or lo == hi:
            return []
        # a combination within the n best changes only the n - 1 parts that lose least; of equals, the first
        own = losses[lo:hi]
        if len(own) >= n:
            most = np.partition(own, n - 2)[n - 2]
            less = np.flatnonzero(own < most)
            some = np.sort(np.r_[less, np.flatnonzero(own == most)[: n - 1 - len(less)]])
        else:
            some = np.arange(len(own))
        mixed: list[tuple[int, tuple[tuple[int, int], ...]]] = [(0, ())]
        choices = {i: self.choices(names[lo + i], n) for i in some.tolist() if own[i] < NONE}
        for i, found in choices.items():
            more = [(lost + found[0].score - c.score, picks + ((i, k),) if k else picks) for lost, picks in mixed for k, c in enumerate(found)]
            mixed = heapq.nsmallest(n, more)
        at = {i: (int(begin[lo + i] - begin[lo]), int(lengths[lo + i])) for i in choices}
        return [(total - lost, [(*at[i], choices[i][k].ids) for i, k in picks]) for lost, picks in mixed[1:]]

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes of the texts ids[ends[i] : ends[i + 1]], one after the other, where each begins and the last ends). A blank that stands before every text is taken away."""
        lengths = self.byte_length[ids]
        begin = np.r_[0, np.cumsum(lengths)]
        out = self.all_bytes[ranges(self.byte_at[ids], lengths)]
        at = begin[ends]
        first = at[:-1][at[:-1] < at[1:]]
        first = first[out[first] == 0x20]
        keep = np.ones(len(out), bool)
        keep[first] = False
        return out[keep], at - np.searchsorted(first, at)

    def decode(self, ids) -> str:
        """The text of a segmentation. A blank that stands before every text is taken away."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text[:1] == " " else text


@cache
def lattice(path: str) -> Lattice:
    return Lattice(path)


OUT = "ids array<int>, score double, others array<struct<score double, edits array<struct<at int, gone int, ids array<int>>>>>"


def encode(docs: DataFrame, path: str, n: int = 4, text: str = "text") -> DataFrame:
    """docs with ids (the best segmentation), score, and others (up to n - 1 further ones, best first, as edits to ids) in place of the text.

    The pieces are the model file's own. A segmentation's score is the sum of its pieces' log-probabilities: the file's scores of a unigram model; of a byte-pair model, those that
    follow from the ranks. A blank is put before each text that isn't empty.
    Characters that are no pieces become pieces of their UTF-8 bytes, so decoding gives back every text.
    Nulls: a null text is an empty one, with no ids, score 0 and no others. Other columns are kept as they are, under their names.
    """
    keep = [c for c in docs.columns if c != text]
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(OUT).fields])
    return docs.select(*keep, text).mapInArrow(lambda batches: _encoded(batches, path, n), schema)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, n: int) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is the text, with ids, score and others in its place."""
    model = lattice(path)
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            b = whole.slice(at, TEXTS)
            found = model.nbest_of(b.column(b.num_columns - 1).to_pylist(), n)
            lists = pa.ListArray.from_arrays(pa.array(found.ends, pa.int32()), pa.array(found.ids))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, pa.array(np.array(found.scores) / UNIT), _edits(found.others)], names=[*b.schema.names[:-1], "ids", "score", "others"])


def _edits(others: list[list[tuple[int, list[tuple[int, int, array]]]]]) -> pa.ListArray:
    """NBest.others as nested lists."""
    each = [x for some in others for x in some]
    edits = [e for _, x in each for e in x]
    ids = array("i")
    for *_, x in edits:
        ids.extend(x)
    ends = lambda lists: pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
    column = lambda values, kind: pa.array(np.array(values, kind))
    new = pa.ListArray.from_arrays(ends([e[2] for e in edits]), column(ids, np.int32))
    changes = pa.StructArray.from_arrays([column([e[0] for e in edits], np.int32), column([e[1] for e in edits], np.int32), new], ["at", "gone", "ids"])
    rows = pa.StructArray.from_arrays([column([s / UNIT for s, _ in each], np.float64), pa.ListArray.from_arrays(ends([x for _, x in each]), changes)], ["score", "edits"])
    return pa.ListArray.from_arrays(ends(others), rows)


def _spelled(column: pa.ListArray, model: Lattice) -> tuple[np.ndarray, np.ndarray]:
    ends = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
    return model.spell(column.flatten().to_numpy(zero_copy_only=False), ends)


def _decoded(column: pa.ListArray, model: Lattice) -> list[str]:
    text, ends = _spelled(column, model)
    held = text.tobytes()
    return [held[a:b].decode(errors="replace") for a, b in zip(ends.tolist(), ends[1:].tolist())]


def decode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """docs with text in place of the ids; a null list gives an empty text."""
    keep = [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_decoded(b.column(b.num_columns - 1), lattice(path)), pa.string())], names=[*keep, "text"])

    return docs.select(*keep, ids).mapInArrow(run, docs.select(*keep).schema.add("text", "string"))


def _model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(docs: DataFrame, path: str, n: int = 4, *more: str) -> DataFrame:
    """doc_id, n_pieces, ids, score, others, text_crc32 (of the text that ids decode to), and the columns named in more. Texts are encoded and decoded in one task, one batch after the other.

    A null or empty text has no pieces, score 0, no others and crc 0. Repeated rows and null ids are rows like any other; an empty table gives no rows; further columns are ignored. A text without any blank is
    searched with memory for its scores, its arcs of a few thousand positions, and its n lists of ids.
    """
    keep = [F.col("doc_id").cast("long").alias("doc_id"), *more]
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*more).schema.fields) if more else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _encoded(batches, path, n):
            doc_id, *own, ids, score, others = b.columns
            text, ends = _spelled(ids, lattice(path))
            crcs = [zlib.crc32(text[a:z]) for a, z in zip(ends.tolist(), ends[1:].tolist())]
            columns = [doc_id, pc.list_value_length(ids).cast(pa.int64()), ids, score, others, pa.array(crcs, pa.int64()), *own]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids", "score", "others", "text_crc32", *more])

    return docs.select(*keep, "text").mapInArrow(run, f"doc_id long, n_pieces long, {OUT}, text_crc32 long{kinds}")


def op4(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """pieces() of every row of documents. Its ids are the likeliest segmentation by the pieces' log-probabilities, not the merges that the byte-pair encoder of the same file would make."""
    return pieces(table(spark, sf_dir, "documents"), path or _model())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, encoded and decoded as in op4: doc_id, lang, source, n_pieces, ids, score, others, text_crc32."""
    return pieces(docs, _model(), 4, "lang", "source").select("doc_id", "lang", "source", "n_pieces", "ids", "score", "others", "text_crc32")
