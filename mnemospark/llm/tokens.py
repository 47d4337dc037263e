"""Token ids of whole texts by the tokenizers library, with a bounded memo of words.

Both public vocabularies cut a text before every single space and around every single line end, and no
token crosses those cuts. So in printable text whose blanks are single spaces and line ends, the ids of
a text are those of its words in a row; words repeat, and a worker remembers the ids of those it met.
New words go to the library many at a time, parted by a token that none of them holds. Any other text,
and any that may hold the string of a special token, is encoded whole.
"""

from __future__ import annotations

import gc
import json

import numpy as np
import pyarrow as pa

from mnemospark.llm.common import text_bytes
from mnemospark.llm.texthash import LOWER_LUT, mix, span_hashes

#: Places of remembered words, each taken by the latest word that falls on it, and ids that they hold before all are forgotten.
SLOTS, POOL, WIDE = 1 << 20, 4_000_000, 16
_SLOT = np.dtype([("low", "<u8"), ("high", "<u8"), ("at", "<i8"), ("n", "<u4")])
#: The first so many bytes of eight.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_CONTROL, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_CONTROL[:32] = _CONTROL[127] = _BLANK[[10, 32]] = True
_CONTROL[10] = False
#: The printable character that stands for each byte in byte-level vocabularies: itself, or one from U+0100 on, in order.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _SELF} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_SELF}))}

#: ASCII letters, and marks without the apostrophe, which can begin a token with letters.
_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
_MARK = np.array([33 <= c < 127 and c != 39 and not chr(c).isalnum() for c in range(256)])


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes: those of a plain ``encode(text, add_special_tokens=False)``.

    ``ordinary``: the strings of special tokens are ordinary text, and texts begin with a blank of their own.
    """

    def __init__(self, path: str, keeps_space: bool, ordinary: bool = False) -> None:
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = ordinary
        self.keeps_space, self.ordinary = keeps_space, ordinary
        # How the strings begin that the library takes for tokens of their own; texts that hold one are encoded whole.
        self.added = sorted({t.content.encode()[:2] for t in self.tok.get_added_tokens_decoder().values() if t.content and not (ordinary and t.special)})
        # What parts new words: a line end where blanks are kept, else a mark that is one token.
        marks = ["\n"] if keeps_space else "§¶©®™"
        self.mark, self.mark_id = next((c, ids[0]) for c in marks if len(ids := self.tok.encode(c, add_special_tokens=False).ids) == 1)
        # The same model without the patterns that cut a text, for words of letters alone, which no pattern cuts,
        # and without the library's own memo, which new words pass in vain.
        with open(path, encoding="utf-8") as f:
            m = json.load(f)["model"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        suffix = {"end_of_word_suffix": m["end_of_word_suffix"]} if m.get("end_of_word_suffix") else {}
        self.plain = Tokenizer(models.BPE(vocab=m["vocab"], merges=merges, cache_capacity=0, **suffix))
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.slots = np.zeros(SLOTS, _SLOT)
        self.pool, self.used = np.zeros(POOL, "<u4"), 0

    @property
    def id_bytes(self) -> int:
        """Bytes that hold any id of the vocabulary."""
        return 2 if self.tok.get_vocab_size() <= 1 << 16 else 4

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of unlike words."""
        odd = [w for w in words if self.mark in w]
        found = dict(zip(odd, self._whole(odd), strict=True))
        letters = [w for w in words if w[1:].isalpha() and (w[0] == " " or w[0].isalpha())]
        self._joined(letters, True, found)
        self._joined(list(set(words).difference(letters, odd)), False, found)
        return [found[w] for w in words]

    def _joined(self, words: list[str], letters: bool, found: dict[str, bytes]) -> None:
        """Has the library encode many words as one text, and takes it apart at the mark."""
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            tok, text = self.tok, None
            if letters:
                text = "\x00".join(some if self.keeps_space else map(str.lower, some))
                try:  # letters up to U+00FF are single composed characters with a lower case of one character
                    text.encode("latin-1")
                except UnicodeEncodeError:
                    text = None
            if text is not None:
                # As the byte-level step would write them: a printable character for each byte.
                tok, mark = self.plain, "\n" + self.mark.encode().decode("latin-1").translate(BYTES) + "\n"
                text = text.encode().decode("latin-1").translate(BYTES).replace(BYTES[0], mark)
            else:
                text = (self.mark if self.keeps_space else f" {self.mark} ").join(some)
            ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            b = ids.tobytes()
            starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(b)]
            found.update(zip(some, [b[i:j] for i, j in zip(starts, ends, strict=True)], strict=True))

    def _plain(self, texts: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts are those of their words in a row: printable but for line ends, without what may begin an added token, and, where blanks are kept, none beside another or at an end."""
        odd = np.zeros(len(offsets) - 1, bool)
        if not len(raw):
            return ~odd

        def of(mask: np.ndarray) -> np.ndarray:
            """The texts that hold a place of the mask."""
            return np.unique(np.searchsorted(offsets, np.flatnonzero(mask), side="right") - 1)

        odd[of(_CONTROL[raw])] = True
        for x in self.added:
            begins = raw == x[0]
            if len(x) > 1:
                begins[:-1] &= raw[1:] == x[1]
                begins[-1] = False
            odd[of(begins)] = True
        for k in of(raw > 127):
            odd[k] = odd[k] or not texts[int(k)].as_py().replace("\n", " ").isprintable()
        if self.keeps_space:
            blank = _BLANK[raw]
            beside = np.zeros(len(raw), bool)
            full = offsets[1:] > offsets[:-1]
            beside[offsets[1:][full] - 1] = True
            if not self.ordinary:
                beside[offsets[:-1][full]] = True
            beside[1:] |= blank[:-1]
            if self.ordinary:  # the blank before a text is the only one at an end that may stand, and none is beside that of another text
                beside[offsets[:-1][full]] = False
            odd[of(blank & beside)] = True
        return ~odd

    def arrow(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (null: none)."""
        on = gc.isenabled()
        gc.disable()  # hundreds of thousands of words and no cycles: collections would find nothing
        try:
            return self._arrow(texts)
        finally:
            if on:
                gc.enable()

    def _arrow(self, texts: pa.Array) -> list[bytes]:
        """Words of up to WIDE bytes are told apart by these bytes; longer ones by a hash within a batch, and are encoded anew in each."""
        raw, offsets = text_bytes(texts)
        n = len(offsets) - 1
        plain = self._plain(texts, raw, offsets)
        # Marks after an ASCII letter are cut from it, as the patterns of both vocabularies cut them.
        begin = _MARK[raw]
        begin[1:] &= _LETTER[raw[:-1]]
        begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        if self.keeps_space:  # a blank begins the word after it, a line end stands for itself
            begin |= _BLANK[raw]
            begin[1:] |= raw[:-1] == 10
            starts = np.flatnonzero(begin)
            ends = np.r_[starts[1:], len(raw)].astype(np.int64)
        else:
            raw = LOWER_LUT[raw]
            inside = ~_BLANK[raw]
            begin[1:] |= ~inside[:-1]
            begin &= inside
            last = inside.copy()
            last[:-1] &= ~inside[1:] | begin[1:]
            starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        of = np.searchsorted(offsets, starts, side="right") - 1
        if not plain.all():
            keep = plain[of]
            starts, ends, of = starts[keep], ends[keep], of[keep]
        size = ends - starts
        padded = np.r_[raw, np.zeros(WIDE, np.uint8)]
        eight = np.lib.stride_tricks.as_strided(padded, (len(raw) + WIDE - 7, 8), (1, 1))
        low = eight[starts].view("<u8")[:, 0] & _MASK[np.minimum(size, 8)]
        high = np.zeros(len(starts), np.uint64)
        more = np.flatnonzero(size > 8)
        high[more] = eight[starts[more] + 8].view("<u8")[:, 0] & _MASK[np.minimum(size[more] - 8, 8)]
        h = mix(low ^ mix(high + np.uint64(1)))
        long = np.flatnonzero(size > WIDE)
        if len(long):
            h[long] = mix(span_hashes(raw, starts[long], ends[long]))
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        low_u, high_u, size_u, slot = low[first], high[first], size[first], (h[first] & np.uint64(SLOTS - 1)).astype(np.int64)
        if not (np.array_equal(low_u[inverse], low) and np.array_equal(high_u[inverse], high) and np.array_equal(size_u[inverse], size)):
            return self._whole(["" if t is None else t for t in texts.to_pylist()])  # two words of a hash
        if self.used > POOL:
            self.slots["n"], self.used = 0, 0
        row = self.slots[slot]
        known = (row["low"] == low_u) & (row["high"] == high_u) & (row["n"] > 0) & (size_u <= WIDE)
        at, count = row["at"].copy(), row["n"].astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            data = raw.tobytes()
            words = [str(data[a:b], "utf-8") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            ids = self._words(words)
            count[new] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            at[new] = self.used + np.cumsum(count[new]) - count[new]
            ids = np.frombuffer(b"".join(ids), "<u4")
            if self.used + len(ids) > len(self.pool):
                self.pool = np.r_[self.pool, np.zeros(max(len(ids), POOL // 4), "<u4")]
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            new = new[(size_u[new] <= WIDE) & (count[new] > 0)]
            rows = np.zeros(len(new), _SLOT)
            rows["low"], rows["high"], rows["at"], rows["n"] = low_u[new], high_u[new], at[new], count[new]
            self.slots[slot[new]] = rows
        long = count[inverse]
        total = np.cumsum(long)
        out = self.pool[np.repeat(at[inverse] - (total - long), long) + np.arange(total[-1] if len(total) else 0)].tobytes()
        cuts = (4 * np.r_[0, total][np.searchsorted(of, np.arange(n + 1))]).tolist()
        whole = iter(self._whole([texts[int(k)].as_py() for k in np.flatnonzero(~plain)]))
        return [out[a:b] if ok else next(whole) for ok, a, b in zip(plain.tolist(), cuts[:-1], cuts[1:], strict=True)]

    def texts(self, texts: list[str | None]) -> list[bytes]:
        return self.arrow(pa.array(texts, pa.string()))


_encoders: dict[tuple[str, bool, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool, ordinary: bool = False) -> Encoder:
    """The worker's own, made once; one at a time, so that its memo is all a worker holds."""
    key = (path, keeps_space, ordinary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*key)
    return _encoders[key]
