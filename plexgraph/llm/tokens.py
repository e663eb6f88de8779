"""Ids of whole texts from a public tokenizer, each distinct word once through a bounded table."""

from __future__ import annotations

from plexgraph.llm.words import Table, Words, chunks

#: Words that a worker's table holds before it starts anew, and bytes of their ids.
CACHE = 2_000_000
CACHE_BYTES = 32 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(text) -> little-endian 16-bit ids of the whole text.

    The tokenizer lower-cases and never joins what stands on both sides of white
    space (its pre-tokenizer drops it), so the pieces between ASCII white space,
    with A-Z lower-cased, are encoded one by one, each distinct piece once while
    it stays in the table; all are looked up together, in numpy. It cuts between
    letters and signs too, but for the apostrophe and the signs of added entries,
    so pieces are cut there.
    Pieces of letters alone give one word each, whose last id, and no other, is
    that of an entry with the word-end mark; so they can be encoded as one text
    and told apart by those ids. The vocabulary has to have fewer than 65,536 ids.
    """

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # for words of a-z alone the normaliser does nothing and the pre-tokenizer only cuts at blanks
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tok.get_vocab()
        if max(vocabulary.values(), default=0) >= 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        added = "".join(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.signs = bytes(set(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~") - set(added.encode()))
        self._forget()

    def _forget(self) -> None:
        """Of word k: ids from first[k] on, size[k] of them."""
        import numpy as np

        self.table, self.n, self.used = Table(), 0, 0
        self.first, self.size, self.pool = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint16)

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """The ids of each of these different pieces."""
        import numpy as np

        seen: dict[bytes, bytes] = {}
        ascii_ = [w for w in new if w.isalpha()]
        other = [w for w in new if not w.isalpha()]
        letters = [w for w in other if w.decode().isalpha()]
        other = [w for w in other if not w.decode().isalpha()]
        for tok, plain in ((self.bare, ascii_), (self.tok, letters)):
            for k in range(0, len(plain), 1000):
                part = plain[k : k + 1000]
                ids = np.array(tok.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u2")
                at = np.flatnonzero(self.ends[ids]) + 1
                if len(at) != len(part) or at[-1] != len(ids):
                    other += part
                    continue
                flat, cut = ids.tobytes(), (at * 2).tolist()
                seen.update(zip(part, map(flat.__getitem__, map(slice, [0, *cut], cut))))
        for k in range(0, len(other), 2000):
            part = other[k : k + 2000]
            got = self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            seen.update((w, np.array(e.ids, "<u2").tobytes()) for w, e in zip(part, got))
        return [seen[w] for w in new]

    def _add(self, key, ids: list[bytes]) -> None:
        import numpy as np

        size = np.array([len(x) // 2 for x in ids], np.int32)
        n, used = self.n + len(ids), self.used + int(size.sum())
        if n > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * n), np.resize(self.size, 2 * n)
        if used > len(self.pool):
            self.pool = np.resize(self.pool, 2 * used)
        self.pool[self.used : used] = np.frombuffer(b"".join(ids), "<u2")
        self.size[self.n : n] = size
        self.first[self.n : n] = self.used + np.cumsum(size) - size
        self.table.add(key, np.arange(self.n, n, dtype=np.int32))
        self.n, self.used = n, used

    def encode(self, texts: list[bytes], tail: bytes = b"") -> list[bytes]:
        """texts: UTF-8. tail: ids that follow each text."""
        return [x for _, some in chunks(texts) for x in self._encode(some, tail)]

    def _encode(self, texts: list[bytes], tail: bytes) -> list[bytes]:
        import numpy as np

        if self.n > CACHE or self.used * 2 > CACHE_BYTES:
            self._forget()
        words = Words(texts, self.signs)
        at = self.table.find(words.key)
        missed = np.flatnonzero(at < 0)
        if len(missed):
            new, one = np.unique(words.key[missed], return_index=True)
            self._add(new, self._learn([words.of(k) for k in missed[one]]))
            at[missed] = self.table.find(words.key[missed])
        size = self.size[at]
        end = np.cumsum(size)
        place = np.arange(end[-1] if len(end) else 0)
        place += np.repeat(self.first[at] - (end - size), size)
        flat = self.pool[place].tobytes()
        cut = (np.concatenate([[0], end])[words.cut] * 2).tolist()
        return [flat[i:j] + tail for i, j in zip(cut, cut[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker and path."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
