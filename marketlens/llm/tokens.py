"""Token ids of whole texts by a public vocabulary file.

The vocabulary ``word_bpe_49k.json`` drops white space and never joins words
across it, so the ids of a text are the ids of its white-space parts in turn.
Invented and natural prose repeats its words; each Python worker keeps the ids
of the parts it has met (a bounded table) and asks the library only for new
ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marketlens.llm.text import HELD

#: ASCII marks that may follow a word; not the apostrophe, which can start a contraction.
_MARKS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def _byte_chars() -> list[str]:
    """Byte-level vocabularies write each byte as one visible character: visible
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_BYTE_CHAR = _byte_chars()


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PartIds:
    """White-space parts (UTF-8) and their ids, as Arrow and numpy arrays.

    Some 30 bytes a part; beyond ``limit`` bytes the parts that have not been met for
    the longest time go."""

    def __init__(self, path: str, limit: int = 24 << 20):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids beyond 16 bits")
        self.limit, self.run = limit, 0
        self.parts = pa.array([], pa.large_binary())
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, "<u2")  # ids of part i: ids[start[i]:start[i + 1]]
        self.met = np.zeros(0, np.int32)                                   # the last run that had it

    def _new(self, part: bytes) -> bytes:
        """Ids of a part that is not one of its own simpler forms."""
        word = part.decode()
        if word.isalpha():
            # One run of letters is one word before merges: it goes to the model
            # directly, each byte as the character that stands for it.
            if not part.isalpha():
                word = self.tokenizer.normalizer.normalize_str(word)
                chars = "".join(map(_BYTE_CHAR.__getitem__, word.encode()))
            else:
                chars = word
            if word.isalpha():
                return np.array([t.id for t in self.tokenizer.model.tokenize(chars)], "<u2").tobytes()
        return np.array(self.tokenizer.encode(part.decode(), add_special_tokens=False).ids, "<u2").tobytes()

    def _lookup(self, keys: pa.Array) -> np.ndarray:
        """Places of different keys in the table; those that are not in it are added."""
        place = pc.fill_null(pc.index_in(keys, value_set=self.parts), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = place < 0
        self.met[place[~new]] = self.run
        if new.any():
            added = keys.filter(pa.array(new))
            ids = [self._new(k) if k else b"" for k in added.to_pylist()]
            place[new] = len(self.parts) + np.arange(len(ids))
            self.parts = pa.concat_arrays([self.parts, added])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) // 2 for x in ids])])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u2")])
            self.met = np.concatenate([self.met, np.full(len(ids), self.run, np.int32)])
        return place

    def _split(self, parts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each part as a simple one and the marks after it (empty for most).

        The vocabulary folds the case of ASCII letters, and letters end where marks
        start, so both have the part's ids in a row."""
        base = pc.ascii_rtrim(parts, characters=_MARKS.decode())
        size, whole = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (base, parts))
        marked = (size > 0) & (size < whole)
        letters = pc.ascii_is_alpha(base).to_numpy(zero_copy_only=False)
        ends = marked & letters
        other = np.flatnonzero(marked & ~letters)
        ends[other] = [self.tokenizer.normalizer.normalize_str(b).isalpha() for b in base.take(pa.array(other)).to_pylist()]
        body = pc.if_else(pa.array(ends), base, parts)
        body = pc.if_else(pc.ascii_is_alpha(body), pc.ascii_lower(body), body)
        offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset:parts.offset + len(parts) + 1]
        rest = np.where(ends, whole - size, 0)
        at = np.concatenate([[0], np.cumsum(rest)])
        data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)[np.repeat(offsets[1:] - at[1:], rest) + np.arange(at[-1])]
        marks = pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(at), pa.py_buffer(data)])
        return body.cast(pa.large_binary()), marks

    def _shrink(self) -> None:
        """Keeps the half that has been met last."""
        if self.parts.nbytes + self.ids.nbytes + self.start.nbytes + self.met.nbytes <= self.limit:
            return
        stay = np.sort(np.argsort(self.met, kind="stable")[len(self.met) // 2:])
        self.ids, ends = _gather(self.ids, self.start[stay], np.diff(self.start)[stay])
        self.start, self.met, self.parts = np.concatenate([[0], ends]), self.met[stay], self.parts.take(pa.array(stay))

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (UTF-8): all ids in a row, and the bounds of each text's.

        The parts are told apart by Arrow, so that each different part of the
        run is looked up once; the ids are then gathered by numpy."""
        self.run += 1
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        parts = split.flatten().dictionary_encode()
        body, marks = self._split(parts.dictionary)
        n = len(body)
        keys = pa.concat_arrays([body, marks]).dictionary_encode()
        place = self._lookup(keys.dictionary)[keys.indices.to_numpy()]
        # a part's ids: its body's, then its marks'
        place = place.reshape(2, n).T.ravel()
        flat, ends = _gather(self.ids, self.start[place], self.start[place + 1] - self.start[place])
        self._shrink()
        first = np.concatenate([[0], ends])[0::2]
        which = parts.indices.to_numpy()
        ids, ends = _gather(flat, first[which], first[which + 1] - first[which])
        return ids, np.concatenate([[0], ends])[split.offsets.to_numpy()]


def _gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ids in a row, and the end of each."""
    ends = np.cumsum(size)
    return ids[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


_KEPT: dict[str, PartIds] = {}
HELD.append(_KEPT)


def part_ids(path: str) -> PartIds:
    """The table of this worker, kept until the worker turns to other work."""
    if path not in _KEPT:
        _KEPT[path] = PartIds(path)
    return _KEPT[path]
