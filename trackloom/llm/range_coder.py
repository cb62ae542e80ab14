"""Adaptive context-mixing range coder of token ids, the lanes of a block side by side.

Three predictions of the next id are mixed: the id that followed the same two
ids (order 2), the id that followed the same id (order 1), and counts of the
ids that neither gave (order 0).  What each is worth is learned by how often it
came true lately: adaptive weights for each state of trust in the two
followers.  A range coder (of asymmetric numerals, so it codes backwards what
it decodes forwards) codes which prediction gives the id and, if no follower
does, the id itself, as one range.

A block is cut into lanes of about STEPS ids, which go step by step together as
numpy's arrays and share one model: a step is predicted from all steps before
it in all lanes.  Followers learn after each step, weights and counts at the
steps that say so.  Nothing is carried from block to block.  All arithmetic is
of integers: any machine decodes what another one encoded.
"""

from __future__ import annotations

import numpy as np

#: Ids of a block and of a lane; followers kept for pairs of ids (a power of two).
BLOCK, STEPS, SLOTS = 1 << 21, 256, 1 << 18
#: What a seen id adds to its count (an unseen one has 1), what a prediction that came true adds to its weight, and the sum at which weights are halved.
SEEN, RIGHT, FULL = 64, 8, 1 << 16
#: Trust in a follower goes from 0 to 7; it stands above its id + 1 (0 is none).
TRUST_AT, FOLLOWER = 28, np.int32((1 << 28) - 1)
#: Trust after a prediction that was wrong (first row) or right; a wrong follower of trust 0 or 1 is replaced.
NEXT = (np.array([[1, 1, 1, 1, 2, 2, 3, 3], [1, 2, 3, 4, 5, 6, 7, 7]], np.int32) << TRUST_AT).astype(np.int32).ravel()
#: Bits of the sum of weights and of a word of the code; a lane's state is at least LEAST and below LEAST << WORD.
CHOICE, WORD, LEAST = 10, 32, 1 << 31
#: Bits of an id at most, so that a range is at most 31 bits.
MOST_BITS = 20
U = np.uint64


class Mixer:
    """Followers, weights and counts for ids of so many bits."""

    def __init__(self, bits: int, slots: bool):
        if bits > MOST_BITS:
            raise ValueError(f"ids of {bits} bits; the coder takes at most {MOST_BITS}")
        self.bits, self.slots = bits, slots
        self.literal = max(bits + 1, min(bits + 4, 31 - CHOICE))
        self.scale = self.literal + CHOICE
        self.two, self.one = np.zeros(SLOTS, np.int32), np.zeros(1 << bits, np.int32)
        self.seen = np.full((128, 3), RIGHT, np.int64)
        self.count, self.new = np.ones(1 << bits, np.int64), []
        self._weigh()
        self._count()

    def predict(self, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Followers by order 2 and 1 (id + 1; 0 is none), and where the weights of their state begin."""
        self.last = last
        self.at = ((last * 0x9E3779B1 ^ before) * 0x85EBCA6B) >> 13 & (SLOTS - 1)
        two, one = self.two.take(self.at), self.one.take(last)
        self.trust = two >> TRUST_AT, one >> TRUST_AT
        two &= FOLLOWER
        one &= FOLLOWER
        state = self.trust[0] << 3
        state |= self.trust[1]
        state <<= 1
        state |= two == one
        state *= 3
        self.state = state.astype(np.int64)
        return two, one, self.state

    def learn(self, t: int, own: np.ndarray, new: np.ndarray, literals: np.ndarray, two: np.ndarray, one: np.ndarray) -> None:
        """The model after the ids (+ 1: new) that came at step t, by the weights own."""
        self.seen += RIGHT * np.bincount(own, minlength=384).reshape(128, 3)
        for table, at, old, trust in ((self.two, self.at, two, self.trust[0]), (self.one, self.last, one, self.trust[1])):
            right = old == new
            after = NEXT.take(right * np.int32(8) + trust)
            right |= trust > 1
            after |= np.where(right, old, new)
            table[at] = after
        self.new.append(literals)
        t += 1
        if t < 32 or t % 4 == 0:
            self._weigh()
        if t & (t - 1) == 0 or t % 128 == 0:
            self._count()

    def _weigh(self) -> None:
        sums = self.seen.sum(1)
        if (full := sums > FULL).any():
            self.seen[full] = (self.seen[full] + 1) >> 1
            sums = self.seen.sum(1)
        size = 1 + self.seen * ((1 << CHOICE) - 3) // sums[:, None]
        size[np.arange(128), size.argmax(1)] += (1 << CHOICE) - size.sum(1)
        ends = size.cumsum(1)
        self.size, self.low = size.ravel(), (ends - size).ravel() << self.literal
        self.low_one, self.low_none = (ends[:, k].repeat(3) << self.literal for k in range(2))

    def _count(self) -> None:
        if self.new:
            self.count += SEEN * np.bincount(np.concatenate(self.new), minlength=1 << self.bits)
            self.new.clear()
        size = 1 + self.count * ((1 << self.literal) - (1 << self.bits)) // self.count.sum()
        size[size.argmax()] += (1 << self.literal) - size.sum()
        self.id_size, self.id_low = size, size.cumsum() - size
        if self.slots:
            self.id_at = np.arange(1 << self.bits, dtype=np.uint16 if self.bits <= 16 else np.uint32).repeat(size)


def _lanes(n: int) -> tuple[int, int]:
    """Steps and lanes of a block of n ids; the last lane may be shorter."""
    steps = -(-n // max(n // STEPS, 1))
    return steps, -(-n // steps) if n else 0


def encode_block(ids: np.ndarray, bits: int) -> bytes:
    """The code of ids below 2^bits: the lanes' states, then words in the order in which they are read."""
    n = len(ids)
    steps, lanes = _lanes(n)
    table = np.zeros(steps * lanes, np.int64)
    table[:n] = ids
    table = np.ascontiguousarray(table.reshape(lanes, steps).T) if n else table
    mixer, ranges = Mixer(bits, slots=False), []
    before = last = np.zeros(lanes, np.int64)
    literal = mixer.literal
    for t in range(steps):
        m = -(-(n - t) // steps)
        now = table[t, :m]
        two, one, own = mixer.predict(before[:m], last[:m])
        new = now.astype(np.int32)
        new += np.int32(1)
        miss = two != new
        own = own + miss
        own += miss & (one != new)
        low, size = mixer.low.take(own), mixer.size.take(own)
        rest = np.flatnonzero(miss & (one != new))
        literals, weight = now.take(rest), size.take(rest)
        size <<= literal
        low[rest] += weight * mixer.id_low.take(literals)
        size[rest] = weight * mixer.id_size.take(literals)
        ranges.append((low.astype(np.uint32), size.astype(np.uint32)))
        mixer.learn(t, own, new, literals, two, one)
        before, last = last, now
    state, words, room = np.full(lanes, LEAST, U), [], U(63 - mixer.scale)
    for low, size in reversed(ranges):
        size = size.astype(U)
        x = state[: len(low)]
        full = np.flatnonzero(x >= size << room)
        if len(full):
            over = x[full]
            words.append(over.astype("<u4"))
            x[full] = over >> U(WORD)
        q = x // size
        x += ((q << U(mixer.scale)) + low) - q * size
    return state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(code: bytes, n: int, bits: int) -> np.ndarray:
    """The n ids of a block.  A damaged code gives wrong ids, no error: callers compare checksums."""
    steps, lanes = _lanes(n)
    raw = np.zeros(max(len(code) + 4, 8 * lanes) // 4 + n, "<u4")
    raw.view(np.uint8)[: len(code)] = np.frombuffer(code, np.uint8)
    x, words, at = raw[: 2 * lanes].view("<i8").astype(np.int64), raw[2 * lanes :], 0
    out = np.zeros((steps, lanes), np.uint32)
    mixer = Mixer(bits, slots=True)
    before = last = np.zeros(lanes, np.int64)
    literal, most, inside = mixer.literal, np.int32((1 << bits) - 1), (1 << mixer.scale) - 1
    for t in range(steps):
        m = -(-(n - t) // steps)
        x = x[:m]
        two, one, state = mixer.predict(before[:m], last[:m])
        slot = x & inside
        miss, none = slot >= mixer.low_one.take(state), slot >= mixer.low_none.take(state)
        own = state + miss
        own += none
        slot -= mixer.low.take(own)
        size = mixer.size.take(own)
        now = np.where(miss, one, two)
        now -= np.int32(1)
        now &= most
        rest = np.flatnonzero(none)
        weight, inner = size.take(rest), slot.take(rest)
        literals = mixer.id_at.take((inner.view(U) // weight.view(U)).view(np.int64), mode="clip").astype(np.int64)
        now[rest] = literals
        size <<= literal
        slot[rest] = inner - weight * mixer.id_low.take(literals)
        size[rest] = weight * mixer.id_size.take(literals)
        x >>= mixer.scale
        x *= size
        x += slot
        short = np.flatnonzero(x < LEAST)
        if len(short):
            x[short] = x.take(short) << WORD | words[at : at + len(short)]
            at += len(short)
        out[t, :m] = now
        mixer.learn(t, own, now + np.int32(1), literals, two, one)
        before, last = last, now.astype(np.int64)
    return out.T.ravel()[:n]


def encode_blocks(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    """The code of each block of ids below 2^bits."""
    return [encode_block(b, bits) for b in blocks]


def decode_blocks(codes: list[bytes], lengths: np.ndarray, bits: int) -> list[np.ndarray]:
    """The ids of each block."""
    return [decode_block(c, int(n), bits) for c, n in zip(codes, lengths, strict=True)]
