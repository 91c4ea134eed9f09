"""Whole-text encoding with a public tokenizer, through a cache of encoded words.

Both tokenizer files split a text into pre-tokens before any merge, and a single blank between two
other characters always ends a pre-token. So a text is cut at such blanks, each different piece is
encoded by the library once, and the ids of the pieces are strung together. Texts with one of the
vocabulary's added tokens in them are encoded as a whole. The result equals encoding the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Different pieces that one worker remembers; beyond, it forgets all and starts again.
CACHE_WORDS = 400_000
#: Text bytes handled at a time.
CHUNK_BYTES = 4_000_000

_SPACE = r"\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts in which white space starts, ends or meets other white space.
_IRREGULAR = rf"^[{_SPACE}]|[{_SPACE}]$|[{_SPACE}][{_SPACE}]| [.,]"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters (without the dotted capital I, which turns into two characters): a run of them is one pre-token, and a
#: full stop or comma after one starts another.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_POINT, _WORD = f"([{_LATIN}])([.,])", re.compile(f" ?[{_LATIN}]+")
#: Bytes as the characters that byte-level vocabularies write them with: printable ones as they are, others from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHAR = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


class PieceEncoder:
    """Ids of whole texts. ``blank_joins``: a blank belongs to the word after it (byte-level files); otherwise
    the tokenizer drops white space."""

    def __init__(self, path: str, blank_joins: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Texts that hold one of the vocabulary's added tokens (such as an end-of-text mark) go to the library as a whole.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "(?i)" + "|".join(added) if added else None
        self.blank_joins = blank_joins
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.n_ids = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        word = [_WORD.fullmatch(p) is not None for p in pieces]
        self._remember([p for p, w in zip(pieces, word) if w], self._word_ids)
        self._remember([p for p, w in zip(pieces, word) if not w], self._text_ids)

    def _text_ids(self, pieces: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(pieces, add_special_tokens=False)]

    def _word_ids(self, pieces: list[str]) -> list[list[int]]:
        """Single pre-tokens of Latin letters need no more than the library's merges."""
        merge = self.model.tokenize
        shown = [p if p.isascii() and p[0] != " " else "".join(map(_AS_CHAR.__getitem__, p.encode())) for p in (pieces if self.blank_joins else map(str.lower, pieces))]
        return [[t.id for t in merge(s)] for s in shown]

    def _remember(self, pieces: list[str], encode) -> None:
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            ids = encode(part)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for one in ids for x in one), np.uint32, int(sizes.sum()))
            n = len(self.known)
            while n + len(part) > len(self.sizes):
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            while self.n_ids + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.sizes[n : n + len(part)] = sizes
            self.starts[n : n + len(part)] = self.n_ids + np.cumsum(sizes) - sizes
            self.flat[self.n_ids : self.n_ids + len(flat)] = flat
            self.n_ids += len(flat)
            self.known.update(zip(part, range(n, n + len(part))))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Cache numbers of pieces (each different)."""
        get = self.known.get
        got = [get(p, -1) for p in pieces]
        new = [p for p, g in zip(pieces, got) if g < 0]
        if new:
            self._learn(new)
            got = [get(p) for p in pieces]
        return np.array(got, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text starts (one more entry than texts)."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        marked = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        if marked.any():
            return self._with_marks(texts, marked)
        return self._plain(texts)

    def _with_marks(self, texts: pa.Array, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, bounds = self._plain(pc.if_else(pa.array(marked), "", texts))
        own = np.split(ids, bounds[1:-1])
        for i in np.flatnonzero(marked):
            own[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(own), np.concatenate([[0], np.cumsum(list(map(len, own)))])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.blank_joins:
            odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
            plain = pc.if_else(pa.array(~odd), texts, "") if odd.any() else texts
            cut = pc.replace_substring_regex(pc.replace_substring(plain, "\n", " \n"), _POINT, r"\1 \2")
            lists = pc.split_pattern(cut, " ")
        else:
            odd = np.zeros(len(texts), bool)
            cut = pc.replace_substring_regex(pc.ascii_lower(pc.replace_substring(texts, "\n", " ")), _POINT, r"\1 \2")
            lists = pc.split_pattern(cut, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values
        bounds, words = bounds - bounds[0], words.slice(bounds[0], bounds[-1] - bounds[0])
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        unique = coded.dictionary.to_pylist()
        if self.blank_joins:
            after = self._numbers([u if u[:1] in ("\n", ".", ",") else " " + u for u in unique])
            numbers = after[codes]
            first = bounds[:-1]
            heads, back = np.unique(codes[first], return_inverse=True)
            numbers[first] = self._numbers([unique[h] for h in heads])[back]
        else:
            numbers = self._numbers(unique)[codes]
        if odd.any():
            parts = np.split(numbers, bounds[1:-1])
            for i in np.flatnonzero(odd):
                cut = _CUT.split(texts[int(i)].as_py())
                pieces = [cut[0], *(" " + p for p in cut[1:])]
                each = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
                parts[i] = self._numbers(list(each))[[each[p] for p in pieces]]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            numbers = np.concatenate(parts)
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[bounds]


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, blank_joins: bool) -> PieceEncoder:
    """The encoder of this worker process."""
    key = (path, blank_joins)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(path, blank_joins)
    return _ENCODERS[key]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Regroups batches so that each holds about ``limit`` bytes of ``column`` (or one longer row); nulls become ''."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        return whole.to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        batch = batch.set_column(at, column, pc.fill_null(batch.column(at), ""))
        sizes = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = int(sizes[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, done + limit - size, "right")))
            stop = min(stop, batch.num_rows)
            held.append(batch.slice(start, stop - start))
            size += int(sizes[stop - 1]) - done
            start = stop
            if size >= limit or start < batch.num_rows:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; a path is kept as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
