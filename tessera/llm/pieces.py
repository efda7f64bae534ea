"""Byte-fallback BPE pieces, encoded through a table of each prefix's last token, and decoded.

In BPE the tokens of a text's prefix that ends at a token boundary are the first tokens of the whole text's encoding,
so every prefix has one last token. It is the one among the vocabulary's matches that end there whose
neighbour on the left, itself the last token of the shorter prefix, would not have merged with it. An automaton yields
the matches, a walk back through both tokens' merges decides the pair, and the ids are then read from the end. Time
is linear in the text, however long a stretch without a space is. The stretches that are new in a batch are looked at together,
each once; their ids are kept in a pool, from which those of all texts are gathered.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Distinct stretches whose ids a worker remembers, and ids and pairs of them; beyond it the memory starts afresh.
REMEMBERED, POOLED, PAIRS = 200_000, 4_000_000, 400_000
#: Characters whose prefixes' last tokens are found at once, in stretches that are this short; longer ones are taken alone.
FILLED, SHORT = 1 << 18, 64
#: Rows, and bytes of them, that are handled, and handed on, at once; a longer text is taken by itself.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1024, 4 << 20
NORMAL, UNKNOWN, CONTROL, BYTE = "normal", "unknown", "control", "byte"

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Vocabulary:
    """What a model file says: each piece with its score and kind. Plain lists, so it travels to executors by value."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]) -> None:
        self.pieces, self.scores, self.kinds = pieces, scores, kinds

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        kind = lambda i: UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) else BYTE if sp.is_byte(i) else NORMAL
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], [kind(i) for i in ids])


class Coder:
    """Encoder and decoder for one vocabulary, without begin or end ids and without sampling."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        self.pieces = v.pieces
        self.normal = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == NORMAL}
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(v.pieces):
            if v.kinds[i] == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
        # characters are atoms even where they aren't pieces themselves; such atoms get ids beyond the vocabulary
        chars = sorted({c for p in self.normal for c in p} - self.normal.keys())
        self.atoms = self.normal | {c: len(v.pieces) + k for k, c in enumerate(chars)}
        self.strings = [*v.pieces, *chars]
        order = sorted((i for p, i in self.normal.items() if len(p) > 1), key=lambda i: -v.scores[i])
        self.rank = [-1] * len(self.strings)
        for r, i in enumerate(order):
            self.rank[i] = r
        self.halves: list[tuple[int, int] | None] = [None] * len(self.strings)
        matched = {c: i for c, i in self.atoms.items() if len(c) == 1}
        for i in order:
            if (last := self._last_merge(self.strings[i])) is not None:  # else no text ever ends up with this piece
                self.halves[i] = last
                matched[self.strings[i]] = i
        self.length = [len(x) for x in self.strings]
        self.lengths = np.array(self.length, np.int64)
        self._automaton(matched)
        #: Neighbouring characters that some piece holds; a text falls apart wherever two others meet.
        joined = {a + b for p in self.normal for a, b in zip(p, p[1:])}
        self.cut_at_space = not any(x[1] == SPACE != x[0] for x in joined)
        self.cut_at_line = not any("\n" in x for x in joined)
        self.pairs: dict[int, bool] = {}
        self._empty()
        # decoding: what each id stands for, and the same without a leading space
        kinds = v.kinds
        self.is_byte = np.array([k == BYTE for k in kinds], bool)
        self.shown = [
            b"" if k == CONTROL else " \u2047 ".encode() if k == UNKNOWN else bytes([self.byte_of[i]]) if k == BYTE else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(v.pieces, kinds))
        ]
        self.empty = np.array([not x for x in self.shown], bool)
        self.shown_table = pa.array([*self.shown, *(x[1:] if x[:1] == b" " else x for x in self.shown)], pa.large_binary())

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two tokens whose merge completes ``piece`` when it is encoded by itself; None if it isn't completed."""
        tokens = [self.atoms[c] for c in piece]
        while len(tokens) > 1:
            best, at = None, -1
            for k in range(len(tokens) - 1):
                whole = self.normal.get(self.strings[tokens[k]] + self.strings[tokens[k + 1]])
                if whole is not None and (best is None or self.rank[whole] < self.rank[best]):
                    best, at = whole, k
            if best is None:
                return None
            if len(tokens) == 2:
                return tokens[0], tokens[1]
            tokens[at : at + 2] = [best]
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay two tokens side by side.

        Goes back in time from the finished pair: of the two tokens at the border the one merged later is taken apart,
        and the tokens then at the border must not have a merge of their own that comes before that one. Of equal merges the
        left one comes first.
        """
        limit, good = len(self.rank) + 1, True
        rank, halves, strings = self.rank, self.halves, self.strings
        while True:
            whole = self.normal.get(strings[left] + strings[right])
            if whole is not None and rank[whole] < limit:
                good = False
                break
            if rank[left] > rank[right]:
                limit, left = rank[left], halves[left][1]
            elif rank[right] >= 0:
                limit, right = rank[right] + 1, halves[right][0]
            else:
                break
        return good

    def _automaton(self, matched: dict[str, int]) -> None:
        """Aho-Corasick over all tokens that texts end up with, once as tables for many short stretches side by side and once
        for one long stretch. ``ends`` has the tokens that end in a state, longest first, from ``first[state]`` on."""
        step: list[dict[str, int]] = [{}]
        own = [-1]
        for piece, token in matched.items():
            state = 0
            for ch in piece:
                if (to := step[state].get(ch)) is None:
                    to = step[state][ch] = len(step)
                    step.append({})
                    own.append(-1)
                state = to
            own[state] = token
        fail, ends = [0] * len(own), [()] * len(own)
        queue = list(step[0].values())
        for state in queue:
            ends[state] = ((own[state],) if own[state] >= 0 else ()) + ends[fail[state]]
            for ch, to in step[state].items():
                back = fail[state]
                while back and ch not in step[back]:
                    back = fail[back]
                fail[to] = step[back].get(ch, 0)
                queue.append(to)
        self.goto = _Table()
        keys = [(state << 21 | ord(ch), to) for state, row in enumerate(step) for ch, to in row.items()]
        self.goto.put(*(np.array(x, np.int64) for x in zip(*keys)))
        self.fail = np.array(fail, np.int64)
        self.n_ends = np.array(list(map(len, ends)), np.int64)
        self.first_end = np.cumsum(self.n_ends) - self.n_ends
        self.ends = np.array([t for x in ends for t in x], np.int64)
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, token in matched.items():
            self.matches.add_word(piece, token)
        self.matches.make_automaton()
        self.known_pairs = _Table()

    def _stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs."""
        keys = left * len(self.strings) + right
        got = self.known_pairs.get(keys)
        if (new := got < 0).any():
            fresh = np.unique(keys[new])
            if len(self.known_pairs) + len(fresh) > PAIRS:
                self.known_pairs = _Table()
            self.known_pairs.put(fresh, np.array([self.compatible(*divmod(k, len(self.strings))) for k in fresh.tolist()], np.int64))
            got[new] = self.known_pairs.get(keys[new])
        return got == 1

    def _together(self, stretches: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many) of short stretches, longest first: all advance by one character at a time. -1 stands for a
        character that no piece has."""
        chars = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        last = np.full((int(sizes[0]) + 1, len(stretches)), -1, np.int64)  # the last token of each prefix
        state = np.zeros(len(stretches), np.int64)
        length = self.lengths
        for i in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -i, "left"))  # those that have more than i characters
            ch, now = chars[begin[:n] + i], state[:n]
            to = self.goto.get(now << 21 | ch)
            left = np.flatnonzero((to < 0) & (now > 0))
            while len(left):
                now[left] = self.fail[now[left]]
                to[left] = self.goto.get(now[left] << 21 | ch[left])
                left = left[(to[left] < 0) & (now[left] > 0)]
            state[:n] = to = np.maximum(to, 0)
            open_, k = np.arange(n), 0
            while len(open_ := open_[self.n_ends[to[open_]] > k]):
                token = self.ends[self.first_end[to[open_]] + k]
                before = last[i + 1 - length[token], open_]
                good = before < 0
                if not good.all():
                    some = np.flatnonzero(~good)
                    good[some] = self._stay(before[some], token[some])
                last[i + 1, open_[good]] = token[good]
                open_, k = open_[~good], k + 1
        # ids from each end
        rows, at, parts = np.arange(len(stretches)), sizes.copy(), []
        while len(rows):
            token = last[at, rows]
            parts.append((rows, token))
            at -= np.where(token < 0, 1, length[token])
            rows, at = rows[at > 0], at[at > 0]
        of = np.concatenate([x for x, _ in reversed(parts)])
        ids = np.concatenate([x for _, x in reversed(parts)])[np.argsort(of, kind="stable")]
        return ids, np.bincount(of, minlength=len(stretches))

    def _alone(self, stretch: str) -> list[int]:
        """The ids of one stretch, however long."""
        length, pairs, base, compatible = self.length, self.pairs, len(self.strings), self.compatible
        last = array("i", [-1]) * (len(stretch) + 1)
        for end, token in self.matches.iter(stretch):
            if last[end + 1] < 0:
                before = last[end + 1 - length[token]]
                if before >= 0:
                    if (good := pairs.get(before * base + token)) is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        good = pairs[before * base + token] = compatible(before, token)
                    if not good:
                        continue
                last[end + 1] = token
        size, byte_ids, out, k = len(self.pieces), self.byte_ids, array("i"), len(stretch)
        while k:
            if 0 <= last[k] < size:
                out.append(last[k])
                k -= length[last[k]]
            else:
                k -= 1
                out.extend([byte_ids[b] for b in reversed(stretch[k].encode())])
        out.reverse()
        return out

    def _fill(self, stretches: list[str]) -> None:
        """Appends the ids of each stretch to the pool."""
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] <= SHORT]
        counts = np.zeros(len(stretches), np.int64)
        alone = {i: self._alone(stretches[i]) for i in np.flatnonzero(sizes > SHORT).tolist()}
        ids = np.zeros(0, np.int64)
        if len(order):
            ids, counts[order] = self._together([stretches[i] for i in order.tolist()], sizes[order])
            odd = (ids < 0) | (ids >= len(self.pieces))
            if odd.any():
                for i in np.unique(np.repeat(order, counts[order])[odd]).tolist():
                    alone[i] = self._alone(stretches[i])
        own, before = counts[order], np.zeros(len(stretches), np.int64)
        before[order] = np.cumsum(own) - own
        at = 0
        for i in sorted(alone):
            self._pooled(ids, before[at:i], counts[at:i])
            self.pool.extend(alone[i])
            self.starts.append(len(self.pool))
            at = i + 1
        self._pooled(ids, before[at:], counts[at:])

    def _pooled(self, ids: np.ndarray, before: np.ndarray, counts: np.ndarray) -> None:
        ends = np.cumsum(counts)
        if len(ends):
            self.starts.frombytes((ends + len(self.pool)).astype(np.int64).tobytes())
            self.pool.frombytes(ids[np.repeat(before - ends + counts, counts) + np.arange(ends[-1])].astype(np.int32).tobytes())

    def _forget(self) -> None:
        """Keeps the stretches that came up again lately; nothing if these are too many themselves."""
        again = self.hits >= 2
        words = [(memory, w, k) for memory in (self.spaced, self.heads) for w, k in memory.items() if again[k] and len(w) <= 64]
        if 2 * len(words) > REMEMBERED:
            words = []
        starts, pool = np.array(self.starts), np.array(self.pool)
        self._empty()
        for memory, w, k in words:
            dict.__setitem__(memory, w, len(self.starts) - 1)
            self.pool.extend(pool[starts[k] : starts[k + 1]].tolist())
            self.starts.append(len(self.pool))
        self.hits = np.zeros(len(self.starts) - 1, np.int32)

    def _empty(self) -> None:
        #: Ids of all remembered stretches, one after the other, and where each starts.
        self.pool, self.starts = array("i"), array("q", [0])
        self.hits = np.zeros(0, np.int32)
        self.pending: list[str] = []
        self.spaced, self.heads = _Memory(self, SPACE), _Memory(self, "")

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of whole texts: those of text ``i`` stand from ``offsets[i]`` to before ``offsets[i + 1]``."""
        if len(self.starts) > REMEMBERED or len(self.pool) > POOLED:
            self._forget()
        found, ends = array("q"), [0]
        spaced, heads = self.spaced.__getitem__, self.heads.__getitem__
        for text in texts:
            if text:
                marked = SPACE + text.replace(" ", SPACE)
                if not self.cut_at_space:
                    found.append(heads(marked))
                else:
                    for k, line in enumerate(marked.split("\n") if self.cut_at_line else (marked,)):
                        if k:
                            found.append(heads("\n"))
                        if SPACE + SPACE in line:
                            found.extend(map(heads, _STRETCH.findall(line)))
                        elif line:
                            first, *rest = line.split(SPACE)
                            if first:
                                found.append(heads(first))
                            found.extend(map(spaced, rest))
            ends.append(len(found))
        new, self.pending = self.pending, []
        at, size = 0, 0
        for k, stretch in enumerate(new):
            size += len(stretch)
            if size > FILLED or k == len(new) - 1:
                self._fill(new[at : k + 1])
                at, size = k + 1, 0
        if not len(found):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        which, starts, pool = (np.frombuffer(x, t) for x, t in ((found, np.int64), (self.starts, np.int64), (self.pool, np.int32)))
        hits = np.bincount(which, minlength=len(starts) - 1)
        hits[: len(self.hits)] += self.hits
        self.hits = np.minimum(hits, 1 << 30).astype(np.int32)
        lengths = starts[which + 1] - starts[which]
        total = np.concatenate(([0], np.cumsum(lengths)))
        ids = pool[np.repeat(starts[which] - total[:-1], lengths) + np.arange(total[-1])]
        return ids, total[np.array(ends)]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; no ids for an empty one."""
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: one leading space goes, bytes that are no UTF-8 become one replacement mark each."""
        shown, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                shown.append(run.decode("utf-8", "each-byte"))
                run = bytearray()
            shown.append(self.shown[i].decode())
        shown.append(run.decode("utf-8", "each-byte"))
        text = "".join(shown)
        return text[1:] if text[:1] == " " else text

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of the ids from each offset to the next. Bytes of all pieces are gathered at once; texts that begin
        with nothing, or have bytes that are no UTF-8, are decoded by themselves."""
        n, some = len(offsets) - 1, np.diff(offsets) > 0
        first = offsets[:-1][some]
        which = ids.astype(np.int64)
        which[first] += len(self.shown)  # there a leading space goes
        taken = self.shown_table.take(pa.array(which))
        at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)[offsets]
        data = taken.buffers()[2] or pa.py_buffer(b"")
        alone: dict[int, str] = {}
        odd = np.zeros(n, bool)
        odd[some] = self.empty[ids[first]]
        if self.is_byte[ids].any():
            counts = np.concatenate(([0], np.cumsum(self.is_byte[ids])))[offsets]
            odd |= np.diff(counts) > 0
        for i in np.flatnonzero(odd).tolist():
            own = ids[offsets[i] : offsets[i + 1]]
            try:
                if self.empty[own[0]]:
                    raise ValueError
                data[at[i] : at[i + 1]].to_pybytes().decode()
            except ValueError:
                alone[i] = self.decode(own.tolist())
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), data])
        if alone:
            return pa.array([alone[i].encode() if i in alone else whole[i].as_py() for i in range(n)], pa.binary()).cast(pa.string())
        return whole.cast(pa.binary()).cast(pa.string())


_STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class _Table:
    """Whole numbers by whole numbers that aren't negative, many at once: open addressing with linear probing."""

    def __init__(self) -> None:
        self.n, self.shift = 0, 64 - 12
        self.keys, self.values = np.full(1 << 12, -1, np.int64), np.full(1 << 12, -1, np.int32)

    def __len__(self) -> int:
        return self.n

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there are none."""
        at, last = self._slots(keys), len(self.keys) - 1
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1).astype(np.int64)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & last
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that differ and aren't there yet."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            all_keys, all_values = np.concatenate((self.keys[old], keys)), np.concatenate((self.values[old], values))
            bits = max(12, int(2 * len(all_keys)).bit_length())
            self.n, self.shift = 0, 64 - bits
            self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
            keys, values = all_keys, all_values
        self.n += len(keys)
        at, last = self._slots(keys), len(self.keys) - 1
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            here = self.keys[at] == keys
            self.values[at[here]] = values[here]
            keys, values, at = keys[~here], values[~here], (at[~here] + 1) & last


class _Memory(dict):
    """Stretches, without their common beginning, and their places in a coder's pool; new ones are left to be filled in."""

    def __init__(self, coder: Coder, begin: str) -> None:
        super().__init__()
        self.coder, self.begin = coder, begin

    def __missing__(self, key: str) -> int:
        c = self.coder
        place = self[key] = len(c.starts) - 1 + len(c.pending)
        c.pending.append(self.begin + key)
        return place


_coders: dict[int, Coder] = {}


def _coder(vocabulary: Vocabulary) -> Coder:
    """One coder for each vocabulary and worker process."""
    key = hash((tuple(vocabulary.pieces), tuple(vocabulary.scores)))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(vocabulary)
    return _coders[key]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, and bytes of the column unless one row has more."""
    sizes = np.cumsum(np.fromiter((0 if x is None else x for x in pc.binary_length(batch.column(column).cast(pa.large_binary())).to_pylist()), np.int64, batch.num_rows))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        stop = min(at + ROWS_AT_ONCE, max(at + 1, int(np.searchsorted(sizes, before + BYTES_AT_ONCE, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def _mapped(docs: DataFrame, vocabulary: Vocabulary, source: str, added: dict[str, str], each: Callable[[Coder, pa.Array], list[pa.Array]]) -> DataFrame:
    """``docs`` with the columns that ``each(coder, values)`` returns; columns of the same names are replaced."""
    kept = [c for c in docs.columns if c not in added]
    read = docs.select(*kept, F.col(source).alias("_source"))
    schema = docs.select(*kept, *(F.lit(None).cast(t).alias(c) for c, t in added.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for whole in batches:
            texts = pa.types.is_string(whole.schema.types[-1]) or pa.types.is_large_string(whole.schema.types[-1])
            for b in _slices(whole, len(kept)) if texts else (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *each(coder, b.column(len(kept)))], [*kept, *added])

    return read.mapInArrow(run, schema)


def _encoded(coder: Coder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    ids, offsets = coder.encode_all([t or "" for t in texts.to_pylist()])
    return ids, offsets, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def _decoded(coder: Coder, lists: pa.Array) -> pa.Array:
    sizes = np.array([len(x) if x is not None else 0 for x in (lists.to_pylist())], np.int64)
    return coder.decode_all(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate(([0], np.cumsum(sizes))))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as array<int>. A null text is empty and has no ids.

    Every row gives a row, repeated ones too; an empty table gives none. An input column of the new one's name is replaced.
    """
    return _mapped(docs, vocabulary, text, {ids: "array<int>"}, lambda c, t: [_encoded(c, t)[2]])


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of each array of ids; null or no ids give an empty text. Rows and names as in ``encode``."""
    return _mapped(docs, vocabulary, ids, {text: "string"}, lambda c, x: [_decoded(c, x)])


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass over the rows."""

    def both(coder: Coder, texts: pa.Array) -> list[pa.Array]:
        flat, offsets, lists = _encoded(coder, texts)
        return [lists, coder.decode_all(flat, offsets)]

    return _mapped(docs, vocabulary, text, {ids: "array<int>", decoded: "string"}, both)
