"""Words of many texts at once, in numpy over one buffer: no Python object for a word.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. It
is known by a 64-bit hash of its bytes; with n different words a false meeting
has a chance of about n squared / 2 ** 65.
"""

from __future__ import annotations

#: Words of more bytes are hashed one by one.
LONG = 64
#: Bytes of texts (about) that are cut into words together.
CHUNK = 1 << 20


def mixed(x):
    """A bijection of 64-bit numbers that spreads their bits."""
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def unmixed(x):
    """The number that ``mixed`` made x of."""
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(pow(0x81DADEF4BC2DD44D, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0x7FB5D329728EA185, -1, 1 << 64))
    return x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))


class Words:
    """The words of some texts, in order: arrays ``start`` and ``end`` in ``flat``, ``key``, and ``cut``, the first word of each text and the number of all.

    signs: a word is cut wherever one of a-z and one of these ASCII signs meet.
    """

    def __init__(self, texts: list[bytes], signs: bytes = b""):
        import numpy as np

        flat = b" ".join(texts).lower()
        self.flat = flat
        x = np.frombuffer(flat + bytes(8), np.uint8)
        inside = np.empty(len(flat) + 2, bool)
        inside[0] = inside[-1] = False
        np.greater(x[: len(flat)] - np.uint8(9), 4, out=inside[1:-1])
        inside[1:-1] &= x[: len(flat)] != 32
        edge = inside[1:] != inside[:-1]
        if signs:
            is_sign = np.zeros(256, bool)
            is_sign[list(signs)] = True
            letter, sign = x[: len(flat)] - np.uint8(97) < 26, is_sign[x[: len(flat)]]
            edge[1:-1] |= (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
            edge = np.flatnonzero(edge)
            self.start, self.end = edge[inside[1:][edge]], edge[inside[:-1][edge]]
        else:
            edge = np.flatnonzero(edge)
            self.start, self.end = edge[::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.cut = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(sizes)]))
        self.key = self._keys(x)

    def _keys(self, x):
        import numpy as np
        from xxhash import xxh64_intdigest

        words = np.lib.stride_tricks.as_strided(x[:8].view(np.uint64), (len(x) - 7,), (1,))
        size = self.end - self.start
        h = mixed(size.astype(np.uint64))
        mask = np.array([(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)
        who, at, left = slice(None), self.start, size
        while len(at):
            part = words[at] & mask[np.minimum(left, 8) - 1]
            h[who] = mixed(h[who] ^ part)
            more = np.flatnonzero((left > 8) & (left <= LONG))
            who = more if isinstance(who, slice) else who[more]
            at, left = at[more] + 8, left[more] - 8
        for k in np.flatnonzero(size > LONG):
            h[k] = xxh64_intdigest(self.flat[self.start[k] : self.end[k]], 1)
        return np.maximum(h, np.uint64(1))  # 0 is an empty place of a table

    def of(self, k: int) -> bytes:
        return self.flat[self.start[k] : self.end[k]]


def key(word: bytes) -> int:
    """The key of one word that holds no white space, as ``Words`` has it."""
    return int(Words([word]).key[0])


def chunks(texts: list[bytes], size: int = CHUNK):
    """(first, texts) of runs of texts of about ``size`` bytes together; a longer text is a run of its own."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > size:
            yield at, texts[at:k]
            at, held = k, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


class Table:
    """A map from keys (64 bits, not 0) to numbers: open addressing in numpy arrays."""

    def __init__(self, bits: int = 12):
        import numpy as np

        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, key):
        """The number of each key, -1 where there is none."""
        import numpy as np

        out = np.full(len(key), -1, np.int32)
        slot, todo = (key >> np.uint64(64 - self.bits)).astype(np.int64), None
        while len(key):
            have = self.keys[slot]
            hit = have == key
            if todo is None:
                out[hit] = self.values[slot[hit]]
            else:
                out[todo[hit]] = self.values[slot[hit]]
            go = np.flatnonzero(~hit & (have != 0))
            todo = go if todo is None else todo[go]
            slot, key = (slot[go] + 1) & ((1 << self.bits) - 1), key[go]
        return out

    def add(self, key, value) -> None:
        """Keys are different, and not yet here."""
        import numpy as np

        if (self.n + len(key)) * 2 > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, values = self.keys[old], self.values[old]
            self.__init__(max(self.bits + 1, int(2 * (self.n + len(key)) - 1).bit_length()))
            self.add(keys, values)
        self.n += len(key)
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(key):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.keys[slot[own]], self.values[slot[own]] = key[own], value[own]
            rest = np.ones(len(key), bool)
            rest[own] = False
            key, value = key[rest], value[rest]
            slot = (slot[rest] + 1) & ((1 << self.bits) - 1)
