"""Whole texts to ids of a byte-level BPE, through the distinct parts between their blanks.

A pre-token of such a tokenizer may start with one space but never holds white space behind another
character. A text may therefore be cut before each run of white space, and the ids of the parts are
the ids of the text. Cuts fall before single spaces and before line feeds; each distinct part is
encoded once for many texts. Plain parts go through a merge loop over the same vocabulary, many in
one call, and byte lengths tell whose ids are whose; all others, and texts whose blanks allow no
such cut, go to the tokenizers library itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pre-token pattern of byte-level tokenizers of this kind (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of any regular-expression engine: what Python calls so, and one former member.
FORMER_BLANK = "\u180e"
#: Characters whose kind is the same for every engine; other parts go to the library.
PLAIN = r"^[\x00-\x7f\x{a1}-\x{ff}]{1,200}$"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, all others for the letters from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def gathered(flat: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the parts `codes` one after another, and the place where each part starts (one
    entry more than parts); part k owns counts[k] of the values in `flat`, in order."""
    first = np.cumsum(counts) - counts
    n = counts[codes]
    before = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(before[-1]) + np.repeat(first[codes] - before[:-1], n)], before


def _flags(values: pa.Array, test) -> np.ndarray:
    """`test` of each string, asked once for each distinct one."""
    coded = values.dictionary_encode()
    return np.array([test(x) for x in coded.dictionary.to_pylist()], bool)[coded.indices.to_numpy()]


def _mask(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(bool)


class ChunkEncoder:
    """The ids that `Tokenizer.encode(text, add_special_tokens=False)` gives, for many texts."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = self.model.get_added_tokens_decoder()
        #: Their strings are cut out of a text before anything else, so such texts go whole.
        self.special = sorted(t.content for t in added.values())
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in w): i for w, i in self.model.get_vocab(with_added_tokens=False).items() if i not in added}
        self.merges = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(w) for w in ranks]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that each start with a blank and end without one, joined into one text."""
        if not len(parts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = pc.binary_length(parts).to_numpy()
        joined = parts.buffers()[2].to_pybytes() if parts.offset == 0 else b"".join(x.encode() for x in parts.to_pylist())
        text = joined[:int(size.sum())].decode()
        ids = self.merges.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size), side="right")
        return ids, np.diff(ends, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after another, and how many each has."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= _mask(pc.match_substring(texts, s))
        lists = pc.split_pattern(pc.replace_substring_regex(texts, r"(\n+)", r" \1"), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        feed = _flags(pc.utf8_slice_codeunits(words, 0, 1), lambda c: c == "\n")
        blank = _flags(pc.utf8_slice_codeunits(words, -1), lambda c: not c or c.isspace() or c == FORMER_BLANK)
        first = np.zeros(len(codes), bool)
        first[bounds[:-1]] = True
        # a cut behind white space is no cut: such texts go whole; an empty start is none
        empty = pc.binary_length(words).to_numpy() == 0
        bad = np.zeros(len(codes), bool)
        bad[1:] = ~first[1:] & blank[codes[:-1]] & ~(first[:-1] & empty[codes[:-1]])
        odd |= np.add.reduceat(bad, bounds[:-1]) > 0

        spaced = ~first & ~feed[codes]
        codes = (2 * codes + spaced)[~np.repeat(odd, np.diff(bounds))]
        used = np.zeros(2 * len(words), bool)
        used[codes] = True
        asked = np.nonzero(used)[0]
        plain = (_mask(pc.match_substring_regex(words, PLAIN)) & ~blank)[asked // 2] & (feed[asked // 2] | (asked % 2 == 1))
        asked = np.concatenate([asked[plain], asked[~plain]])
        place = np.zeros(2 * len(words), np.int64)
        place[asked] = np.arange(len(asked))
        space = pa.array(["", " "], pa.large_string()).take(pa.array(asked % 2))
        parts = pc.binary_join_element_wise(space, words.take(pa.array(asked // 2)), pa.scalar("", pa.large_string()))
        flat, counts = self._plain(parts.slice(0, int(plain.sum())))
        rest = self._whole(parts.slice(int(plain.sum())).to_pylist())
        flat, counts = np.concatenate([flat, *rest]), np.append(counts, [len(x) for x in rest]).astype(np.int64)
        ids, before = gathered(flat, counts, place[codes])
        n = np.zeros(len(texts), np.int64)
        n[~odd] = np.diff(before[np.concatenate([[0], np.cumsum(np.diff(bounds)[~odd])])])
        if odd.any():
            whole = self._whole(texts.filter(pa.array(odd)).to_pylist())
            at = np.cumsum(n)[odd]
            n[odd] = [len(x) for x in whole]
            ids = np.insert(ids, np.repeat(at, n[odd]), np.concatenate(whole))
        return ids, n


@lru_cache(maxsize=1)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One for each Python worker, which keeps it from task to task."""
    return ChunkEncoder(path)
