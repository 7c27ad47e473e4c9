"""A FLAC coder and decoder that work on many frames at once.

The decoder reads any fixed or variable block size, 4 to 32 bits, 1 to 8 channels with side and mid coding, constant,
verbatim, fixed and linear-prediction subframes, Rice partitions of either kind with escapes, and wasted bits. It goes
through the Rice codes and the predictors of all frames in step, sample by sample, so the loop's length is a block's
and not a stream's. Frames are found by the seek table; without one, frame after frame in all streams at once. Every
header's CRC-8, every frame's CRC-16 and the stream's MD5 are checked.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 1024
LPC_ORDER, LPC_BITS = 4, 12


class FlacError(ValueError):
    pass


def _table(poly: int, bits: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
        out.append(c & ((1 << bits) - 1))
    return np.array(out, np.int64)


_CRC8, _CRC16 = _table(0x07, 8).tolist(), _table(0x8005, 16)
#: Leading zeros of 16-bit values.
_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16_each(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-16 of data[starts[i] : starts[i] + lengths[i]], all in step."""
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order].astype(np.int64), lengths[order]
    crc = np.zeros(len(at), np.int64)
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    for i, a in enumerate(alive):
        c = crc[:a]
        crc[:a] = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ data[at[:a] + i]]
    out = np.empty(len(at), np.int64)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """UTF-8's way to write a number, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    out = []
    k = next(k for k in range(1, 7) if n < 1 << (5 * k + 6))
    for _ in range(k):
        out.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> (k + 1)) & 0xFF | n, *out[::-1]])


#: Codes of block sizes, as the format fixes them.
_BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
_BLOCK_CODES = {v: k for k, v in _BLOCK_SIZES.items()}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _frame_header(number: int, size: int) -> bytes:
    code = _BLOCK_CODES.get(size, 7)
    head = bytes([0xFF, 0xF8, code << 4, 1 << 1]) + _number(number) + (struct.pack(">H", size - 1) if code == 7 else b"")
    return head + bytes([crc8(head)])


def _lpc(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of each frame, by the autocorrelation method."""
    auto = []
    for lag in range(LPC_ORDER + 1):
        p = flat * 1
        p[lag:] *= flat[: len(flat) - lag]
        for i in range(lag):
            p[starts[sizes > i] + i] = 0
        auto.append(np.add.reduceat(p, starts, dtype=np.int64))
    r = np.stack(auto, 1).astype(np.float64)
    i = np.arange(LPC_ORDER)
    m = r[:, np.abs(i[:, None] - i[None, :])] + (1e-3 * r[:, :1] + 1.0)[:, :, None] * np.eye(LPC_ORDER)
    c = np.linalg.solve(m, r[:, 1:, None])[:, :, 0]
    top = np.abs(c).max(axis=1)
    shift = np.clip(LPC_BITS - 2 - np.ceil(np.log2(np.maximum(top, 1e-9))).astype(np.int64), 0, 15)
    q = np.clip(np.rint(c * (1 << shift)[:, None]), -(1 << (LPC_BITS - 1)), (1 << (LPC_BITS - 1)) - 1).astype(np.int64)
    return q, shift


def encode_each(streams: list[np.ndarray], rate: int = 8000) -> list[bytes]:
    """FLAC of each stream of signed 8-bit samples (at least one each), with a seek point for each frame."""
    sizes_of = [[min(BLOCK, len(s) - a) for a in range(0, len(s), BLOCK)] for s in streams]
    sizes = np.array([n for x in sizes_of for n in x], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate(streams).astype(np.int32)
    each = lambda x: np.repeat(x.astype(np.int32), sizes)  # noqa: E731  of frames, for their samples
    place = np.arange(len(flat), dtype=np.int32) - each(starts)

    coef, shift = _lpc(flat, starts, sizes)
    d1 = flat.copy()
    d1[1:] -= flat[:-1]
    pred = np.zeros(len(flat), np.int32)
    for j in range(LPC_ORDER):
        pred[j + 1 :] += each(coef[:, j])[j + 1 :] * flat[: len(flat) - j - 1]
    ways = [(0, flat, 0), (1, d1, 0), (LPC_ORDER, flat - (pred >> each(shift)), 9 + LPC_ORDER * LPC_BITS)]
    best = np.full(len(sizes), 8) * sizes  # verbatim
    kind, rice = np.full(len(sizes), -1), np.zeros(len(sizes), np.int64)
    codes = np.zeros(len(flat), np.int32)
    for w, (order, res, more) in enumerate(ways):
        u = (res << 1) ^ (res >> 31)
        for i in range(order):  # the warm-up
            u[starts[sizes > i] + i] = 0
        total = np.add.reduceat(u, starts, dtype=np.int64)
        n = np.maximum(1, sizes - order)
        k = np.clip(np.floor(np.log2(np.maximum(total * 0.6931 / n, 1.0))).astype(np.int64), 0, 14)
        bits = order * 8 + more + 10 + n * (1 + k) + np.add.reduceat(u >> each(k), starts, dtype=np.int64)
        win = (bits < best) & (sizes > order)
        best, kind, rice = np.where(win, bits, best), np.where(win, w, kind), np.where(win, k, rice)
        np.copyto(codes, u, where=np.repeat(win, sizes))
    lo, hi = np.minimum.reduceat(flat, starts), np.maximum.reduceat(flat, starts)
    const = lo == hi
    kind = np.where(const, -2, kind)
    order = np.select([kind == 1, kind == 2], [1, LPC_ORDER], 0)

    # The bits of the subframes: each sample's field ends at `ends`; zeros before its leading 1 are there already.
    raw = np.repeat(kind == -1, sizes) | (place < each(order)) | ((place == 0) & np.repeat(const, sizes))  # as it is, in 8 bits
    k = each(rice)
    width = np.where(raw, 8, (codes >> k) + 1 + k)
    width[np.repeat(const, sizes) & ~raw] = 0
    is_rice = kind >= 0
    between = np.where(is_rice, 10, 0) + np.where(kind == 2, 9 + LPC_ORDER * LPC_BITS, 0)  # after the warm-up
    sums = np.cumsum(width, dtype=np.int64)
    before = sums[starts] - width[starts]
    used = sums[starts + sizes - 1] - before
    n_bytes = -(-(8 + used + between) // 8)
    at = np.concatenate([[0], np.cumsum(n_bytes)])
    base = at[:-1] * 8
    ends = (sums + np.repeat(base + 8 + between - before, sizes)).astype(np.int32 if at[-1] < 1 << 27 else np.int64)
    bits = np.zeros(int(at[-1]) * 8, np.uint8)

    def put(end: np.ndarray, value: np.ndarray, n: int) -> None:
        for j in range(n - 1, -1, -1):
            bits[end - 1 - j] = (value >> j) & 1

    rest = np.flatnonzero(~raw & (width > 0))
    kk = k[rest]
    # From high bits to low ones: what is written over an earlier field's low bits is written over again in turn.
    put(ends[rest], (1 << kk) | (codes[rest] & ((1 << kk) - 1)), int(kk.max(initial=-1)) + 1)
    rest = np.flatnonzero(raw)
    own = np.where(place[rest] < each(order)[rest], each(between)[rest], 0)
    put(ends[rest] - own, flat[rest] & 0xFF, 8)
    head = np.select([kind == -2, kind == -1, kind == 0, kind == 1], [0, 1, 8, 9], 32 + LPC_ORDER - 1) << 1
    put(base + 8, head, 8)
    warm = base + 8 + order * 8
    lp = kind == 2
    put(warm[lp] + 4, np.full(int(lp.sum()), LPC_BITS - 1), 4)
    put(warm[lp] + 9, shift[lp], 5)
    for j in range(LPC_ORDER):
        put(warm[lp] + 9 + (j + 1) * LPC_BITS, coef[lp, j], LPC_BITS)
    put((warm + between)[is_rice], rice[is_rice], 10)  # kind 0 in 2 bits, 0 as partition order in 4, the parameter in 4
    packed = np.packbits(bits)

    heads = [_frame_header(i, n) for x in sizes_of for i, n in enumerate(x)]
    parts = [h + packed[a:z].tobytes() for h, a, z in zip(heads, at[:-1], at[1:], strict=True)]
    lengths = np.array([len(p) for p in parts], np.int64)
    joined = np.frombuffer(b"".join(parts), np.uint8)
    crcs = crc16_each(joined, np.cumsum(lengths) - lengths, lengths)
    frames = [p + int(c).to_bytes(2, "big") for p, c in zip(parts, crcs, strict=True)]
    out, i = [], 0
    for s, own in zip(streams, sizes_of, strict=True):
        mine = frames[i : i + len(own)]
        i += len(own)
        spans = [len(x) for x in mine]
        seek, off = [], 0
        for j, (n, b) in enumerate(zip(own, spans, strict=True)):
            seek.append(struct.pack(">QQH", j * BLOCK, off, n))
            off += b
        info = struct.pack(">HH", BLOCK, BLOCK) + min(spans).to_bytes(3, "big") + max(spans).to_bytes(3, "big")
        info += (rate << 44 | 0 << 41 | 7 << 36 | len(s)).to_bytes(8, "big") + hashlib.md5(s.astype(np.int8).tobytes()).digest()
        table = b"".join(seek)
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table + b"".join(mine))
    return out


class Info:
    """What a stream's metadata say: rate, channels, bits, total (samples), md5, first (frame's offset), seek [(sample, offset, size)]."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise FlacError("no FLAC stream")
        at, last, self.seek, self.total = 4, False, [], None
        while not last:
            if at + 4 > len(data):
                raise FlacError("cut off in its metadata")
            last, kind, n = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + n]
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.total, self.md5 = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34]
            elif kind == 3:
                points = (struct.unpack(">QQH", body[i : i + 18]) for i in range(0, n - n % 18, 18))
                self.seek = sorted(p for p in points if p[0] != (1 << 64) - 1)
            at += 4 + n
        if self.total is None:
            raise FlacError("no STREAMINFO")
        self.first = at


def _header(data: bytes, at: int, info: Info) -> tuple[int, int, int, int, int]:
    """Block size, channel assignment, bits, first sample (or -1 - number, of a fixed block size) and the header's length."""
    h = data[at : at + 16]
    if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8:
        raise FlacError("no frame at its place")
    k = 5
    n = h[4]
    if n >= 0xC0:
        more = 7 - (n ^ 0xFF).bit_length()
        n &= (1 << (6 - more)) - 1 if more < 6 else 0
        for _ in range(more):
            n = n << 6 | h[k] & 0x3F
            k += 1
    code, rate = h[2] >> 4, h[2] & 15
    if code == 6:
        size, k = h[k] + 1, k + 1
    elif code == 7:
        size, k = int.from_bytes(h[k : k + 2], "big") + 1, k + 2
    else:
        size = _BLOCK_SIZES.get(code, 0)
    k += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not size or k >= len(h) or crc8(h[:k]) != h[k]:
        raise FlacError("a frame header's CRC-8 is wrong")
    depth = h[3] >> 1 & 7
    return size, h[3] >> 4, _DEPTHS.get(depth, info.bits), n if h[1] & 1 else -1 - n, k + 1


class _Bits:
    """64-bit windows at each byte, for reads at many places at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        w = np.zeros(len(data) + 8, np.uint64)
        for i in range(8):
            w = (w << np.uint64(8)) | padded[i : i + len(w)]
        self.w = w

    def at(self, pos: np.ndarray) -> np.ndarray:
        """The bits from pos, 57 of them at least, from the top."""
        if len(pos) and int(pos.max()) >> 3 >= len(self.w):
            raise FlacError("cut off in a frame")
        return self.w[pos >> 3] << (pos & 7).astype(np.uint64)

    def read(self, pos: np.ndarray, n) -> np.ndarray:
        """n bits from pos, 0 to 56 of them."""
        n = np.asarray(n, np.int64)
        v = self.at(pos)
        return np.where(n > 0, (v >> np.clip(64 - n, 0, 63).astype(np.uint64)).astype(np.int64), 0)

    def signed(self, pos: np.ndarray, n) -> np.ndarray:
        v, n = self.read(pos, n), np.asarray(n, np.int64)
        return np.where(n > 0, v - ((v >> np.maximum(n - 1, 0) & 1) << np.maximum(n, 0)), 0)

    def unary(self, pos: np.ndarray) -> np.ndarray:
        """Zeros before the next 1."""
        q = _ZEROS[(self.at(pos) >> np.uint64(48)).astype(np.int64)]
        more = np.flatnonzero(q == 16)
        while len(more):
            z = _ZEROS[(self.at(pos[more] + q[more]) >> np.uint64(48)).astype(np.int64)]
            q[more] += z
            more = more[z == 16]
        return q


#: Coefficients of the fixed predictors, as the format fixes them.
_FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _subframes(bits: _Bits, pos: np.ndarray, sizes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The samples [sample, frame] of one subframe of each frame, longest frame first, and where the subframes end."""
    frames, longest = len(pos), int(sizes[0])
    head = bits.read(pos, 8)
    pos = pos + 8
    wasted = np.zeros(frames, np.int64)
    w = np.flatnonzero(head & 1)
    if len(w):
        wasted[w] = bits.unary(pos[w]) + 1
        pos[w] += wasted[w]
    depth = depth - wasted
    kind = head >> 1
    if (head >> 7).any() or (((kind >= 2) & (kind < 8)) | ((kind > 12) & (kind < 32))).any():
        raise FlacError("a subframe of a reserved kind")
    out = np.zeros((longest, frames), np.int64)
    const, verb = kind == 0, kind == 1
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    c = np.flatnonzero(const)
    if len(c):
        out[:, c] = bits.signed(pos[c], depth[c])
        pos[c] += depth[c]
    raw = np.where(verb, sizes, np.where(const, 0, order))
    for i in range(int(raw.max(initial=0))):
        f = np.flatnonzero(raw > i)
        out[i, f] = bits.signed(pos[f], depth[f])
        pos[f] += depth[f]
    r = np.flatnonzero(~const & ~verb)
    if not len(r):
        return out << wasted, pos
    most = max(1, int(order[r].max()))
    coef, shift = np.zeros((most, frames), np.int64), np.zeros(frames, np.int64)
    for o, cs in _FIXED.items():
        for j, x in enumerate(cs[:most]):
            coef[j, (kind == 8 + o)] = x
    lp = np.flatnonzero(kind >= 32)
    if len(lp):
        precision = bits.read(pos[lp], 4) + 1
        shift[lp] = bits.signed(pos[lp] + 4, 5)
        if (precision == 16).any() or (shift[lp] < 0).any():
            raise FlacError("a predictor's precision or shift is not allowed")
        pos[lp] += 9
        for j in range(most):
            has = order[lp] > j
            coef[j, lp[has]] = bits.signed(pos[lp[has]], precision[has])
            pos[lp[has]] += precision[has]
    method = bits.read(pos[r], 2)
    if (method > 1).any():
        raise FlacError("a residual of a reserved kind")
    parts = bits.read(pos[r] + 2, 4)
    pos[r] += 6
    wide = 4 + method
    size, start, per = sizes[r], order[r], sizes[r] >> parts
    if (((per << parts) != size) | (per < start)).any():
        raise FlacError("Rice partitions that don't fit the block")
    p, k, esc = pos[r], np.zeros(len(r), np.int64), np.full(len(r), -1, np.int64)
    alive = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    edge = np.unique(np.concatenate([start, *[np.arange(1, 1 << int(q)) * int(s) for q, s in {(int(a), int(b)) for a, b in zip(parts, per, strict=True)}]]))
    edge = set(edge.tolist())
    plain = True
    simple = bool((start == start[0]).all())
    for i in range(int(start.min()), int(size[0])):
        n = int(alive[i])
        if i in edge:
            new = np.flatnonzero((i == start[:n]) | ((i > start[:n]) & (i % np.maximum(per[:n], 1) == 0)))
            if len(new):
                k[new] = bits.read(p[new], wide[new])
                p[new] += wide[new]
                esc[new] = -1
                e = new[k[new] == (1 << wide[new]) - 1]
                if len(e):
                    esc[e] = bits.read(p[e], 5)
                    p[e] += 5
                plain = not (esc >= 0).any()
        if simple or i >= int(start.max()):
            go = slice(0, n)
        else:
            go = np.flatnonzero(start[:n] <= i)
        at, kk = p[go], k[go]
        if plain:
            v = bits.at(at)
            q = _ZEROS[(v >> np.uint64(48)).astype(np.int64)]
            if (q == 16).any():
                q = bits.unary(at)
                v = bits.at(at + q)
                low = v << np.uint64(1)
            else:
                low = v << (q + 1).astype(np.uint64)
            u = (q << kk) | ((low >> np.uint64(1)) >> (63 - kk).astype(np.uint64)).astype(np.int64)
            p[go] = at + q + 1 + kk
            out[i, r[go]] = (u >> 1) ^ -(u & 1)
        else:
            rows = np.arange(n)[go] if isinstance(go, slice) else go
            x = rows[esc[rows] >= 0]
            out[i, r[x]] = bits.signed(p[x], esc[x])
            p[x] += esc[x]
            x = rows[esc[rows] < 0]
            q = bits.unary(p[x])
            u = (q << k[x]) | bits.read(p[x] + q + 1, k[x])
            p[x] += q + 1 + k[x]
            out[i, r[x]] = (u >> 1) ^ -(u & 1)
    pos[r] = p
    pr = np.flatnonzero((order > 0) & ~const & ~verb)
    if len(pr):  # the predictors, in step
        cf, sh, od, sz = coef[:, pr], shift[pr], order[pr], sizes[pr]
        x = out[:, pr].copy()
        for o in np.unique(od):
            g = np.flatnonzero(od == o)
            y, cg, sg = np.ascontiguousarray(x[:, g]), cf[:o, g], sh[g]
            rev = np.ascontiguousarray(cg[::-1])
            for i in range(int(o), int(sz[g[0]])):
                y[i] += (rev * y[i - o : i]).sum(axis=0) >> sg
            x[:, g] = y
        out[:, pr] = x
    return out << wasted, pos


def _decoded(data: np.ndarray, whole: bytes, starts: list[int], infos: list[Info]) -> tuple[list[np.ndarray], list[int], list[int]]:
    """The frames at starts: samples [sample, channel], where each ends, and its first sample or -1 - its number."""
    heads = [_header(whole, a, i) for a, i in zip(starts, infos, strict=True)]
    order = sorted(range(len(heads)), key=lambda i: -heads[i][0])
    sizes, assign, depth = (np.array([heads[i][c] for i in order], np.int64) for c in range(3))
    pos = np.array([(starts[i] + heads[i][4]) * 8 for i in order], np.int64)
    if (assign > 10).any():
        raise FlacError("channels of a reserved kind")
    channels = np.where(assign < 8, assign + 1, 2)
    bits = _Bits(data)
    got = []
    for c in range(int(channels.max())):
        f = np.flatnonzero(channels > c)
        side = ((assign[f] == 8) & (c == 1)) | ((assign[f] == 9) & (c == 0)) | ((assign[f] == 10) & (c == 1))
        x, pos[f] = _subframes(bits, pos[f], sizes[f], depth[f] + side)
        got.append((f, x))
    ends = -(-pos // 8)
    if len(ends) and int(ends.max()) + 2 > len(data):
        raise FlacError("cut off in a frame")
    begun = np.array([starts[i] for i in order], np.int64)
    crcs = crc16_each(data, begun, ends - begun)
    if (crcs != data[ends].astype(np.int64) * 256 + data[ends + 1]).any():
        raise FlacError("a frame's CRC-16 is wrong")
    samples: list = [None] * len(order)
    after, number = [0] * len(order), [0] * len(order)
    column = [{int(i): j for j, i in enumerate(f)} for f, _ in got]
    for j, i in enumerate(order):
        ch = [x[: sizes[j], column[c][j]] for c, (_, x) in enumerate(got) if j in column[c]]
        if assign[j] == 8:
            ch[1] = ch[0] - ch[1]
        elif assign[j] == 9:
            ch[0] = ch[0] + ch[1]
        elif assign[j] == 10:
            mid = ch[0] << 1 | ch[1] & 1
            ch = [(mid + ch[1]) >> 1, (mid - ch[1]) >> 1]
        samples[i] = np.stack(ch, 1)
        after[i], number[i] = int(ends[j]) + 2, heads[i][3]
    return samples, after, number


def decode_each(streams: list[bytes]) -> list[tuple[Info, list[tuple[int, int, np.ndarray]]]]:
    """Of each stream: its metadata, and its blocks as (first sample, offset of the frame in the stream, samples [sample, channel])."""
    infos = [Info(s) for s in streams]
    base = np.cumsum([0, *(len(s) for s in streams)])
    whole = b"".join(streams)
    data = np.frombuffer(whole, np.uint8)
    blocks: list[list] = [[] for _ in streams]
    known = [(i, p) for i, x in enumerate(infos) for p in x.seek if sum(q[2] for q in x.seek) == x.total]
    if known:
        at = [int(base[i]) + infos[i].first + p[1] for i, p in known]
        got, _, _ = _decoded(data, whole, at, [infos[i] for i, _ in known])
        for (i, p), x, a in zip(known, got, at, strict=True):
            if len(x) != p[2]:
                raise FlacError("a seek point is wrong")
            blocks[i].append((p[0], a - int(base[i]), x))
    todo = {i: int(base[i]) + infos[i].first for i in range(len(streams)) if not blocks[i] and infos[i].first < len(streams[i])}
    while todo:
        ids = list(todo)
        got, after, _ = _decoded(data, whole, [todo[i] for i in ids], [infos[i] for i in ids])
        for i, x, a in zip(ids, got, after, strict=True):
            first = blocks[i][-1][0] + len(blocks[i][-1][2]) if blocks[i] else 0
            blocks[i].append((first, todo[i] - int(base[i]), x))
            todo[i] = a
            if a >= base[i + 1]:
                del todo[i]
    for x, own in zip(infos, blocks, strict=True):
        if x.total and sum(len(b[2]) for b in own) != x.total:
            raise FlacError("samples are missing")
        if any(x.md5) and hashlib.md5(b"".join(pcm(b[2], x.bits) for b in own)).digest() != x.md5:
            raise FlacError("the MD5 of the samples is wrong")
    return list(zip(infos, blocks, strict=True))


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian signed samples in whole bytes."""
    n = -(-bits // 8)
    if n == 3:
        return np.ascontiguousarray(samples.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return samples.astype({1: "<i1", 2: "<i2", 4: "<i4"}[n]).tobytes()
