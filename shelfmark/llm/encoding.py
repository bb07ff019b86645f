"""Token ids of Arrow text columns by a public tokenizer, each distinct pre-token encoded once.

For the tokenizers whose pre-tokens never reach over a single space, a text is cut before its
spaces, before its lines and before marks that follow a letter.  Pieces are told apart by 64-bit hashes of
their bytes, computed for a whole batch at once, and found in a table of numpy arrays; only pieces that
the worker has not met lately become strings and go through the library.  Texts where a space stands beside other
white space or that hold a special string, and every text of any other tokenizer, go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfmark.llm.arrays import PIECE, claim, hash_powers, mix, ragged, text_bytes

CACHE = 1 << 18  # pre-tokens that a worker remembers as strings
HASHED = 4  # times as many as hashes, at some 45 bytes each
LONGEST = 64  # bytes of a piece that is remembered by its hash
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # neither letters, digits nor the apostrophe of a contraction
_TOGETHER = 2048  # words that go through the library as one text
_WHITE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class _Pieces:
    """What a worker remembers: the ids of each piece, in one growing array.

    ``encode`` gives ``(ids, lengths)`` of a list of pieces.  With ``words``, letters followed by a run of
    ``_MARKS`` are two pre-tokens, so "word," is put together from "word" and ",".
    """

    def __init__(self, encode, most: int, words: bool, fold: bool):
        self.encode, self.most, self.words, self.fold = encode, most, words, fold
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.lengths = np.zeros(1 << 12, dtype=np.int64)
        self.used = 0

    def find(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece; new ones are encoded."""
        if len(self.place) > self.most:
            self.clear()
        if self.fold:  # the tokenizer lower-cases; its rules for other alphabets are left to it
            pieces = [piece.lower() if piece.isascii() else piece for piece in pieces]
        places = list(map(self.place.get, pieces))
        new = [piece for piece, place in zip(pieces, places, strict=True) if place is None]
        if not new:
            return np.array(places, dtype=np.int64)
        new = list(dict.fromkeys(new))
        single, pairs, stems, runs = {}, [], [], []
        for piece in new:
            stem = piece.rstrip(_MARKS) if self.words else piece
            if stem is not piece and len(stem) < len(piece) and stem.isalpha():
                pairs.append(piece)
                stems.append(stem)
                runs.append(piece[len(stem):])
                piece = stem
            if piece not in self.place:
                single[piece] = None
        self._store(list(single), self.encode)
        if pairs:
            stems = np.fromiter(map(self.place.__getitem__, stems), dtype=np.int64, count=len(pairs))
            marks = self.marks.find(runs)
            a, b = self.lengths[stems], self.marks.lengths[marks]
            starts = np.stack([self.starts[stems], self.used + self.marks.starts[marks]], axis=1).reshape(-1)
            both = np.concatenate([self.ids[: self.used], self.marks.ids[: self.marks.used]])
            self._store(pairs, lambda _: (both[ragged(starts, np.stack([a, b], axis=1).reshape(-1))], a + b))
        return np.fromiter(map(self.place.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def _store(self, new: list[str], encode) -> None:
        if not new:
            return
        ids, lengths = encode(new)
        at, total = len(self.place), len(ids)
        self.ids = _grown(self.ids, self.used + total)
        self.starts, self.lengths = _grown(self.starts, at + len(new)), _grown(self.lengths, at + len(new))
        self.ids[self.used: self.used + total] = ids
        self.lengths[at: at + len(new)] = lengths
        self.starts[at: at + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.place.update(zip(new, range(at, at + len(new)), strict=True))


def _steps(part: dict | None, inner: str) -> list[dict]:
    return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(lengths.sum())), lengths


def _grown(array: np.ndarray, least: int) -> np.ndarray:
    return array if len(array) >= least else np.concatenate([array, np.zeros(max(least, 2 * len(array)) - len(array), array.dtype)])


def _ascii(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters.encode())] = True
    return table


_SOLID = np.zeros(256, dtype=bool)
_SOLID[33:127] = True
_LETTER = _ascii("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_MARK = _ascii(_MARKS)
_LATIN = np.zeros(256, dtype=bool)  # second bytes of letters that begin with C3
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def piece_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of some texts begin; ``begins``: where the texts that are not empty begin.

    No pre-token reaches over these places: spaces, lines between characters that are not white, marks after a letter.
    """
    n = len(data)
    latin = np.zeros(n, dtype=bool)
    latin[1:] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
    ends = _SOLID[data] | latin  # characters that end here and are not white
    cut = data == 32
    inner = np.zeros(n, dtype=bool)
    inner[1:] = (_LETTER[data[:-1]] | latin[:-1]) & _MARK[data[1:]]
    inner[1:-1] |= (data[1:-1] == 10) & ends[:-2] & (_SOLID[data[2:]] | (data[2:] == 0xC3))
    last = begins[begins > 0] - 1
    inner[last[data[last] == 10]] = False  # the line ends with its text
    cut |= inner
    cut[begins] = True
    return np.flatnonzero(cut)


class _Hashed:
    """What a worker remembers of the pieces of a tokenizer: an open-addressing table from hashes to ids."""

    def __init__(self, encode, most: int, fold: bool):
        self.encode, self.most = encode, most
        values = np.arange(256, dtype=np.uint8)
        if fold:  # the tokenizer lower-cases
            values[65:91] += 32
        self.value = mix((values.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        self.bits = max(4, int(2 * most - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.place = np.full(1 << self.bits, -1, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.lengths = np.zeros(1 << 12, dtype=np.int32)
        self.held = self.used = 0

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), dtype=np.uint64)
        a = 0
        while a < len(starts):  # pieces of about PIECE bytes at once
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, side="right")))
            first = starts[a]
            part = data[first: ends[b - 1]]
            powers, inverses = hash_powers(len(part))
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(self.value[part] * powers[: len(part)], out=sums[1:])
            low, high = starts[a:b] - first, ends[a:b] - first
            out[a:b] = mix((sums[high] - sums[low]) * inverses[low] + (high - low).astype(np.uint64))
            a = b
        return out

    def _look(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        mask = len(self.keys) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        found = self.place[slot]
        rest = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & mask
            found[rest] = here = self.place[slot]
            more = (here >= 0) & (self.keys[slot] != keys[rest])
            rest, slot = rest[more], slot[more]
        return found

    def _put(self, keys: np.ndarray, places: np.ndarray) -> None:
        """New keys, each once."""
        mask = len(self.keys) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.place[slot] < 0)
            self.keys[slot[free]], self.place[slot[free]] = keys[free], places[free]  # of several for one slot the last stays
            left = np.flatnonzero(self.place[slot] != places)
            keys, places, slot = keys[left], places[left], (slot[left] + 1) & mask

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each piece; new ones are encoded."""
        keys = self.hashes(data, starts, ends)
        if self.held > self.most:
            self.clear()
        found = self._look(keys)
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        new, first = np.unique(keys[missing], return_index=True)
        if self.held + len(new) > 3 * len(self.keys) // 4:  # too many beside what is held
            new, first = np.unique(keys, return_index=True)
            self.bits = max(self.bits, int(2 * len(new)).bit_length())
            self.clear()
            self._store(data, starts, ends, new, first)
            return self._look(keys)
        self._store(data, starts, ends, new, missing[first])
        found[missing] = self._look(keys[missing])
        return found

    def _store(self, data, starts, ends, new: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(at)  # as they stand in the texts
        new, at = new[order], at[order]
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        ids, lengths = self.encode(pieces)
        total = len(ids)
        self.ids = _grown(self.ids, self.used + total)
        self.starts, self.lengths = _grown(self.starts, self.held + len(new)), _grown(self.lengths, self.held + len(new))
        self.ids[self.used: self.used + total] = ids
        self.lengths[self.held: self.held + len(new)] = lengths
        self.starts[self.held: self.held + len(new)] = self.used + np.cumsum(lengths) - lengths
        self._put(new, np.arange(self.held, self.held + len(new), dtype=np.int32))
        self.used += total
        self.held += len(new)


class Encoder:
    """One tokenizer in one worker process; see ``encoder``."""

    def __init__(self, path: str, most: int = CACHE):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: model.encode(texts, num_threads=1)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.cut = not any(re.search("[^▁]▁", piece) for piece in pieces)
            self.lead, self.size, words, fold, self.opens, self.closes = "", len(pieces), False, False, None, None
            self.odd = rf"^ | $|▁|{_WHITE} | {_WHITE}"
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            self.whole = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            plan = json.loads(model.to_str())
            steps, normal = _steps(plan["pre_tokenizer"], "pretokenizers"), _steps(plan["normalizer"], "normalizers")
            first = steps[0] if steps else {"type": ""}
            bytewise = first["type"] == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and not normal
            dropped = first["type"] == "Split" and first["invert"] and first["behavior"] == "Removed"
            self.cut = words = bytewise or dropped  # pre-tokens: a space and what follows; or runs without white space
            self.lead, self.size = " " if bytewise else "", model.get_vocab_size()
            self.odd = rf"{_WHITE} | {_WHITE}"
            fold = dropped and any(step["type"] == "Lowercase" for step in normal)
            names = [model.id_to_token(k) or "" for k in range(self.size)]
            # words of letters alone are one pre-token each, so they can share a call and be told apart after it
            self.opens = np.array([name.startswith("Ġ") for name in names]) if bytewise else None
            self.closes = np.array([name.endswith("</w>") for name in names]) if dropped else None
            special = "|".join(re.escape(token.content) for token in model.get_added_tokens_decoder().values())
            self.whole_only = rf"{_WHITE} | {_WHITE}" + (f"|(?i:{special})" if special else "")
        self.hashed = _Hashed(self._spaced, HASHED * most, fold) if words else None
        self.rest = _Pieces(self._pieces, most, words, fold)
        self.rest.marks = _Pieces(lambda texts: _flat(self.whole(texts)), most, False, False)
        self.first = _Pieces(lambda texts: _flat(self.whole(texts)), most, False, False) if self.lead else self.rest

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of pieces that follow a space."""
        simple = np.fromiter((piece.isalpha() for piece in pieces), dtype=bool, count=len(pieces)) if self.opens is not None or self.closes is not None else np.zeros(len(pieces), dtype=bool)
        ids, lengths = [], np.zeros(len(pieces), dtype=np.int64)
        order = []
        at = np.flatnonzero(simple)
        for k in range(0, len(at), _TOGETHER):
            some = at[k: k + _TOGETHER]
            found = np.array(self.whole([self.lead + " ".join(pieces[i] for i in some.tolist())])[0], dtype=np.uint32)
            border = np.flatnonzero(self.opens[found]) if self.opens is not None else np.concatenate([[0], np.flatnonzero(self.closes[found]) + 1])[:-1]
            if len(border) != len(some):  # a word that the rule does not hold for: one by one
                simple[some] = False
                continue
            lengths[some] = np.diff(np.append(border, len(found)))
            ids.append(found)
            order.append(some)
        alone = np.flatnonzero(~simple)
        found, lengths[alone] = _flat(self.whole([self.lead + pieces[i] for i in alone.tolist()]))
        ids.append(found)
        order.append(alone)
        flat, order = np.concatenate(ids), np.concatenate(order)
        begins = np.empty(len(pieces), dtype=np.int64)
        begins[order] = np.cumsum(lengths[order]) - lengths[order]
        return flat[ragged(begins, lengths)], lengths

    def _spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of pieces as they stand in a text, spaces included."""
        simple = np.fromiter((piece[:1] == " " and piece[1:].isalpha() for piece in pieces), dtype=bool, count=len(pieces))
        at, alone = np.flatnonzero(simple), np.flatnonzero(~simple)
        spaced, lengths = self._pieces([pieces[i][1:] for i in at.tolist()])
        found, others = _flat(self.whole([pieces[i] for i in alone.tolist()]))
        out = np.zeros(len(pieces), dtype=np.int64)
        out[at], out[alone] = lengths, others
        begins = np.empty(len(pieces), dtype=np.int64)
        begins[at], begins[alone] = np.cumsum(lengths) - lengths, len(spaced) + np.cumsum(others) - others
        return np.concatenate([spaced, found])[ragged(begins, out)], out

    def _encode_hashed(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(column, self.whole_only)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        data, offsets = text_bytes(pc.if_else(whole, "", column) if len(odd) else column)
        begins = offsets[:-1][np.diff(offsets) > 0]
        starts = piece_starts(data, begins) if len(data) else np.zeros(0, dtype=np.int64)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        long = np.flatnonzero(ends - starts > LONGEST)
        if len(long):  # texts of one word and the like: not remembered
            short = np.ones(len(starts), dtype=bool)
            short[long] = False
            places = np.zeros(len(starts), dtype=np.int64)
            places[short] = self.hashed.find(data, starts[short], ends[short])
        else:
            places = self.hashed.find(data, starts, ends)
        table = self.hashed
        lengths, sources = table.lengths[places].astype(np.int64), table.starts[places]
        ids = table.ids[: table.used]
        counts = np.searchsorted(starts, offsets)  # pieces before each text
        extra, texts = [ids], [data[starts[i]: ends[i]].tobytes().decode() for i in long.tolist()]
        if len(long):
            more, n = _flat(self.whole(texts))
            lengths[long], sources[long] = n, len(ids) + np.cumsum(n) - n
            extra.append(more)
        if len(odd):  # one more piece each, where the text stands
            more, n = _flat(self.whole(column.take(pa.array(odd)).to_pylist()))
            begin = sum(map(len, extra)) + np.cumsum(n) - n
            lengths, sources = np.insert(lengths, counts[odd], n), np.insert(sources, counts[odd], begin)
            added = np.zeros(len(counts), dtype=np.int64)
            added[odd + 1] = 1
            counts = counts + np.cumsum(added)
            extra.append(more)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return (np.concatenate(extra) if len(extra) > 1 else ids)[ragged(sources, lengths)], total[counts]

    def split(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """``(pieces, offsets, whole)``: the pieces of each text; ``whole`` marks texts left in one piece, not to be cached."""
        column = column.cast(pa.large_string()).fill_null("")
        if not self.cut:
            return column, np.arange(len(column) + 1), np.ones(len(column), dtype=bool)
        whole = pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", column), " ")
        return lists.values, lists.offsets.to_numpy().astype(np.int64), whole

    def _places(self, column: pa.Array):
        pieces, offsets, whole = self.split(column)
        if not self.cut:
            return None, offsets, whole
        coded = pieces.dictionary_encode()
        firsts = self.first.find(pieces.take(pa.array(offsets[:-1])).to_pylist()) if self.lead else None
        places = self.rest.find(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        return (places, firsts), offsets, whole

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: the ids of text i are ``ids[offsets[i]:offsets[i + 1]]`` (uint32)."""
        if self.hashed:
            return self._encode_hashed(column)
        found, offsets, whole = self._places(column)
        n = len(column)
        if found is None:
            lists = [np.array(ids, dtype=np.uint32) for ids in self.whole(column.fill_null("").to_pylist())]
            counts = np.fromiter(map(len, lists), dtype=np.int64, count=n)
            return np.concatenate([np.zeros(0, dtype=np.uint32), *lists]), np.concatenate([[0], np.cumsum(counts)])
        places, firsts = found
        lengths, starts, ids = self.rest.lengths[places], self.rest.starts[places], self.rest.ids
        if firsts is not None:
            at = offsets[:-1]
            lengths[at], starts[at] = self.first.lengths[firsts], len(ids) + self.first.starts[firsts]
            ids = np.concatenate([ids, self.first.ids[: self.first.used]])
        odd = np.flatnonzero(whole)
        if len(odd):
            lists = [np.array(x, dtype=np.uint32) for x in self.whole(column.take(pa.array(odd)).to_pylist())]
            counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(odd))
            lengths[offsets[odd]], starts[offsets[odd]] = counts, len(ids) + np.cumsum(counts) - counts
            ids = np.concatenate([ids, *lists])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids[ragged(starts, lengths)], ends[offsets]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file (a file that every worker has, such as an installed package's)."""
    claim("encoder", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
