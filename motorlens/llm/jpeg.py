"""Progressive JPEG in numpy: coefficient blocks to streams and back, and streams to RGB.

Streams have three components (4:2:0). The writer sends a first scan of all DC coefficients, one
spectral-selection scan of the AC coefficients for each component, both without the lowest bit, and then
the refining scans of the lowest bit (successive approximation). Restart intervals are short, so that
the reader decodes many of them side by side, one symbol of each at a time.

The writer takes coefficients of which none turns from zero by its lowest bit alone (|AC| is not 1); the
reader takes any progressive stream of this layout, whatever its scan script and Huffman tables.
"""

from __future__ import annotations

import struct
from collections import defaultdict

import numpy as np

#: MCUs (in scans of one component: blocks) between restart markers.
RESTART = 8


def _zigzag() -> np.ndarray:
    """Natural place of each coefficient in zigzag order."""
    order = sorted(((x + y, (y if (x + y) % 2 else x), 8 * y + x) for y in range(8) for x in range(8)))
    return np.array([place for _, _, place in order])


ZIGZAG = _zigzag()
_AC_LENGTHS = {0x06: 1, 0x05: 2, 0x07: 4, 0x04: 4, 0x00: 5, 0x03: 6, 0x02: 6, 0x01: 6}
_AC_LENGTHS |= {s: 12 for s in [*range(0x10, 0xF1, 16), *(16 * r + s for r in range(16) for s in range(1, 11))] if s not in _AC_LENGTHS}
_DC_LENGTHS = {s: 4 for s in range(12)}


def _canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A DHT segment's body (counts and symbols), and code and length of each symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(lengths[s] == n for s in symbols) for n in range(1, 17))
    code, size, codes, sizes = 0, 0, np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s in symbols:
        code <<= lengths[s] - size
        size = lengths[s]
        codes[s], sizes[s] = code, size
        code += 1
    return counts + bytes(symbols), codes, sizes


_DC_BODY, _DC_CODE, _DC_SIZE = _canonical(_DC_LENGTHS)
_AC_BODY, _AC_CODE, _AC_SIZE = _canonical(_AC_LENGTHS)


def _look_up(body: bytes) -> np.ndarray:
    """For each 16 bits ahead: 256 * code length + symbol."""
    out, at, code, nth = np.zeros(1 << 16, np.int64), 16, 0, 0
    for size in range(1, 17):
        for _ in range(body[size - 1]):
            out[code << (16 - size) : (code + 1) << (16 - size)] = 256 * size + body[at + nth]
            code, nth = code + 1, nth + 1
        code <<= 1
    return out


def layout(n_blocks: int) -> tuple[int, int]:
    """MCUs across and down of an image that has room for ``n_blocks``."""
    mcus = max(1, -(-n_blocks // 6))
    across = min(4095, int(mcus**0.5))
    return across, -(-mcus // across)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Grid:
    """Places of the blocks of a batch of images: each image has its Y blocks in raster order, then Cb, then Cr."""

    def __init__(self, across: np.ndarray, down: np.ndarray):
        self.across, self.down = across, down
        self.mcus = across * down
        self.first = 6 * (np.cumsum(self.mcus) - self.mcus)
        self.total = int(6 * self.mcus.sum())

    def mcu_order(self) -> np.ndarray:
        """(MCUs, 6): blocks of each MCU."""
        image = np.repeat(np.arange(len(self.mcus)), self.mcus)
        m = _ranges(np.zeros(len(self.mcus), np.int64), self.mcus)
        w, first, n = self.across[image], self.first[image], self.mcus[image]
        y, x = m // w, m % w
        top = first + 4 * y * w + 2 * x
        return np.stack([top, top + 1, top + 2 * w, top + 2 * w + 1, first + 4 * n + m, first + 5 * n + m], 1)

    def scan(self, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks of a scan in their order, component of each, blocks of each restart interval, intervals of each image."""
        if len(components) > 1:
            blocks = self.mcu_order()
            kinds = np.tile(np.array([0, 0, 0, 0, 1, 2]), len(blocks))
            per, units = 6, self.mcus
            blocks = blocks.ravel()
        else:
            c = components[0]
            units = self.mcus * (4 if c == 0 else 1)
            blocks = _ranges(self.first + self.mcus * (0, 4, 5)[c], units)
            kinds = np.full(len(blocks), c)
            per = 1
        intervals = -(-units // RESTART)
        sizes = np.full(int(intervals.sum()), RESTART)
        sizes[np.cumsum(intervals) - 1] = units - RESTART * (intervals - 1)
        return blocks, kinds, sizes * per, intervals


def _bits_of(v: np.ndarray) -> np.ndarray:
    """Bit length of magnitudes below 2**15."""
    return np.frexp(np.abs(v).astype(np.float32))[1]


def _packed(values: np.ndarray, sizes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``n`` intervals, each filled up with ones, and bytes of each. ``of``: interval of each value, ascending."""
    ends = np.cumsum(sizes)
    bits = np.bincount(of, sizes, n).astype(np.int64)
    lengths = -(-bits // 8)
    base = 8 * (np.cumsum(lengths) - lengths)
    place = ends - sizes + np.repeat(base - (np.cumsum(bits) - bits), np.bincount(of, minlength=n))
    fill = 8 * lengths - bits
    place = np.concatenate([place, base + bits])
    sizes = np.concatenate([sizes, fill])
    values = np.concatenate([values, (np.uint64(1) << fill.astype(np.uint64)) - np.uint64(1)])
    word = place >> 5
    both = values << (64 - (place & 31) - sizes).astype(np.uint64)
    both[sizes == 0] = 0
    count = int(lengths.sum()) // 4 + 3
    out = np.bincount(word, (both >> np.uint64(32)).astype(np.float64), count) + np.bincount(word + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), count)
    return out.astype(np.uint32).astype(">u4").view(np.uint8)[: int(lengths.sum())], lengths


def _marked(data: np.ndarray, lengths: np.ndarray, intervals: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each image: zero bytes after 0xFF, restart markers between intervals."""
    ends = np.cumsum(lengths)
    nth = _ranges(np.zeros(len(intervals), np.int64), intervals)
    inner = np.ones(len(lengths), bool)
    inner[np.cumsum(intervals) - 1] = False
    stuffed = np.flatnonzero(data == 0xFF) + 1
    marks = ends[inner]
    where = np.concatenate([stuffed, np.repeat(marks, 2)])
    what = np.zeros(len(where), np.uint8)
    what[len(stuffed) :: 2] = 0xFF
    what[len(stuffed) + 1 :: 2] = 0xD0 + nth[inner] % 8
    order = np.argsort(where, kind="stable")
    where, what = where[order], what[order]
    out = np.insert(data, where, what).tobytes()
    cuts = np.concatenate([[0], ends[np.cumsum(intervals) - 1]])
    cuts = (cuts + np.searchsorted(where, cuts, "right")).tolist()
    return [out[a:b] for a, b in zip(cuts, cuts[1:])]


def _dc_first(v: np.ndarray, kinds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    diff = np.empty_like(v)
    for c in range(3):
        own = np.flatnonzero(kinds == c)
        x, interval = v[own], of[own]
        diff[own] = x - np.where(np.diff(interval, prepend=-1) == 0, np.roll(x, 1), 0)
    size = _bits_of(diff)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
    return (_DC_CODE[size] << size.astype(np.uint64)) | extra, _DC_SIZE[size] + size, of


def _ac_first(v: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, k = np.nonzero(v)
    x = v[b, k]
    n = len(v)
    run = k - np.where(np.diff(b, prepend=-1) == 0, np.roll(k, 1), -1) - 1
    jumps = run >> 4
    count = np.bincount(b, minlength=n)
    last = np.full(n, -1)
    last[b] = k
    ends = last < v.shape[1] - 1
    upto = np.cumsum(jumps + 1) + np.repeat(np.cumsum(ends) - ends, count)
    total = int(jumps.sum() + len(b) + ends.sum())
    per = count + np.bincount(b, jumps, n).astype(np.int64) + ends
    size = _bits_of(x)
    symbol = 16 * (run & 15) + size
    values, sizes = np.full(total, _AC_CODE[0xF0]), np.full(total, _AC_SIZE[0xF0])
    values[upto - 1] = (_AC_CODE[symbol] << size.astype(np.uint64)) | np.where(x < 0, x + (1 << size) - 1, x).astype(np.uint64)
    sizes[upto - 1] = _AC_SIZE[symbol] + size
    stop = np.cumsum(per)[ends] - 1
    values[stop], sizes[stop] = _AC_CODE[0], _AC_SIZE[0]
    return values, sizes, np.repeat(of, per)


def _ac_refined(v: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the intervals: an end-of-band run over all blocks of each, then a bit for each coefficient."""
    known = np.abs(v) > 1
    bits = (np.abs(v)[known] & 1).astype(np.uint8)
    run = np.floor(np.log2(per)).astype(np.int64)
    head = _AC_SIZE[16 * run] + run
    code = (_AC_CODE[16 * run] << run.astype(np.uint64)) | (per - (1 << run)).astype(np.uint64)
    own = np.add.reduceat(known.sum(1), np.cumsum(per) - per)
    lengths = -(-(head + own) // 8)
    base = 8 * (np.cumsum(lengths) - lengths)
    out = np.ones(int(8 * lengths.sum()), np.uint8)
    for j in range(int(head.max(initial=0))):
        has = j < head
        out[(base + j)[has]] = (code[has] >> (head[has] - 1 - j).astype(np.uint64)) & np.uint64(1)
    out[_ranges(base + head, own)] = bits
    return np.packbits(out), lengths


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _sos(components: tuple[int, ...], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c + 1, 0)), ss, se, 16 * ah + al]))


_TABLES = _segment(0xDB, b"\x00" + b"\x01" * 64)
_CODES = _segment(0xC4, b"\x00" + _DC_BODY) + _segment(0xC4, b"\x10" + _AC_BODY) + _segment(0xDD, struct.pack(">H", RESTART))


def write(coefficients: np.ndarray, grid: Grid, notes: list[bytes]) -> list[bytes]:
    """Streams of a batch of images. ``coefficients``: (blocks, 64) in zigzag order; ``notes``: an application segment's
    body for each."""
    v = coefficients.astype(np.int64)
    if (np.abs(v[:, 1:]) == 1).any():
        raise ValueError("an AC coefficient of 1 or -1 can't be sent by this scan script")
    parts: list[tuple[bytes, list[bytes]]] = []
    blocks, kinds, per, intervals = grid.scan((0, 1, 2))
    of = np.repeat(np.arange(len(per)), per)
    dc = v[blocks, 0]
    parts.append((_sos((0, 1, 2), 0, 0, 0, 1), _marked(*_packed(*_dc_first(dc >> 1, kinds, of), len(per)), intervals)))
    singles = [(c, *grid.scan((c,))) for c in range(3)]
    for c, own, _, sizes, count in singles:
        ac = v[own, 1:]
        half = np.where(ac < 0, -(-ac >> 1), ac >> 1)
        parts.append((_sos((c,), 1, 63, 0, 1), _marked(*_packed(*_ac_first(half, np.repeat(np.arange(len(sizes)), sizes)), len(sizes)), count)))
    parts.append((_sos((0, 1, 2), 0, 0, 1, 0), _marked(*_packed((dc & 1).astype(np.uint64), np.ones(len(dc), np.int64), of, len(per)), intervals)))
    for c, own, _, sizes, count in singles:
        parts.append((_sos((c,), 1, 63, 1, 0), _marked(*_ac_refined(v[own, 1:], sizes), count)))
    out = []
    for i, (w, h, note) in enumerate(zip(grid.across.tolist(), grid.down.tolist(), notes)):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
        out.append(b"".join([b"\xff\xd8", _segment(0xE9, note), _TABLES, frame, _CODES, *(x for head, bodies in parts for x in (head, bodies[i])), b"\xff\xd9"]))
    return out


# ---------------------------------------------------------------- reading


def _parse(data: bytes, at: int, other: np.ndarray) -> dict:
    """Segments of one stream that starts at ``at`` of ``data``; ``other``: places of markers that end scan data."""
    image: dict = {"scans": [], "note": b""}
    tables: dict[int, bytes] = {}
    restart = 0
    at += 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xE9:
            image["note"] = body
        elif marker == 0xDB:
            image["quantum"] = body[1:65]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            if n != 3 or body[7] != 0x22 or width % 16 or height % 16:
                raise ValueError("only 4:2:0 in whole MCUs is read")
            image |= {"across": width // 16, "down": height // 16}
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            if restart != RESTART:
                raise ValueError("another restart interval than this reader's")
            n = body[0]
            parts = tuple(body[1 + 2 * i] - 1 for i in range(n))
            ids = body[2]
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            stop = int(other[np.searchsorted(other, at)])
            image["scans"].append((at, stop, (parts, ss, se, approx >> 4, approx & 15, tables.get(16 + (ids & 15) if ss else ids >> 4, b""))))
            at = stop


class _Bits:
    """Scan data of a batch without stuffed bytes: 64 bits ahead of any byte."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[ff + 1]
        self.removed = ff[after == 0] + 1
        self.restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
        self.other = ff[(after != 0) & ~((after >= 0xD0) & (after <= 0xD7))]
        keep = np.ones(len(raw), bool)
        keep[self.removed] = False
        bare = np.concatenate([raw[keep], np.zeros(16, np.uint8)])
        self.bytes = bare
        self.ahead = np.ndarray((len(bare) - 8,), np.uint64, bare.tobytes(), strides=(1,)).copy().byteswap()

    def place(self, at: np.ndarray) -> np.ndarray:
        """Bit place, without stuffing, of a byte place."""
        return 8 * (at - np.searchsorted(self.removed, at))

    def intervals(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Bit places at which the intervals of scans start."""
        a, b = np.searchsorted(self.restarts, start), np.searchsorted(self.restarts, stop)
        all_ = np.concatenate([start, self.restarts[_ranges(a, b - a)] + 2])
        return self.place(np.sort(all_))

    def peek(self, at: np.ndarray) -> np.ndarray:
        return self.ahead[at >> 3] << (at & 7).astype(np.uint64)


def _extended(window: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed value of the ``size`` bits after ``skip`` bits."""
    x = ((window << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
    return np.where(x < (1 << size) >> 1, x - (1 << size) + 1, x)


def _read_dc_first(bits: _Bits, at: np.ndarray, per: np.ndarray, kinds: np.ndarray, codes: np.ndarray) -> np.ndarray:
    first = np.cumsum(per) - per
    diff = np.zeros(int(per.sum()), np.int64)
    lane = np.arange(len(per))
    at = at.copy()
    for i in range(int(per.max(initial=0))):
        lane = lane[per[lane] > i]
        window = bits.peek(at[lane])
        entry = codes[(window >> np.uint64(48)).astype(np.int64)]
        size, skip = entry & 255, entry >> 8
        diff[first[lane] + i] = _extended(window, skip, size)
        at[lane] += skip + size
    out = np.empty_like(diff)
    of = np.repeat(np.arange(len(per)), per)
    for c in range(3):
        own = np.flatnonzero(kinds == c)
        if len(own):
            run, start = np.cumsum(diff[own]), np.flatnonzero(np.diff(of[own], prepend=-1))
            before = run[start] - diff[own][start]
            out[own] = run - np.repeat(before, np.diff(np.append(start, len(own))))
    return out


def _read_ac_first(bits: _Bits, at: np.ndarray, per: np.ndarray, blocks: np.ndarray, flat: np.ndarray, codes: np.ndarray, ss: int, se: int, al: int) -> None:
    """All intervals side by side, one symbol of each at a time."""
    block = np.cumsum(per) - per
    stop = block + per
    k = np.full(len(per), ss)
    base = blocks * 64
    while len(at):
        window = bits.peek(at)
        entry = codes[(window >> np.uint64(48)).astype(np.int64)]
        skip, symbol = entry >> 8, entry & 255
        run, size = symbol >> 4, symbol & 15
        value = _extended(window, skip, size)
        plain = size > 0
        k = k + run
        here = base[block] + k
        if plain.all():
            flat[here] = value << al
            at = at + skip + size
            k += 1
        else:
            flat[here[plain]] = value[plain] << al
            end = ~plain & (run < 15)
            length = np.where(end, run, 0)
            more = ((window << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - length).astype(np.uint64)).astype(np.int64)
            at = at + skip + size + length
            block = block + np.where(end, (1 << length) + more, 0)
            k = np.where(end, ss, k + 1)
        full = k > se
        block = block + full
        k = np.where(full, ss, k)
        open_ = block < stop
        if not open_.all():
            at, block, stop, k = at[open_], block[open_], stop[open_], k[open_]


def _refine_one(bits: _Bits, at: int, blocks: np.ndarray, flat: np.ndarray, codes: np.ndarray, ss: int, se: int, al: int) -> None:
    """One interval of a refining scan, symbol by symbol."""

    def take(n: int) -> int:
        nonlocal at
        x = 0
        for _ in range(n):
            x = 2 * x + (int(bits.bytes[at >> 3]) >> (7 - (at & 7)) & 1)
            at += 1
        return x

    run_on = 0
    for block in blocks.tolist():
        row = flat[64 * block : 64 * block + 64]
        k = ss
        while k <= se:
            left, fresh = -1, 0
            if not run_on:
                window = int(bits.ahead[at >> 3]) << (at & 7) & (1 << 64) - 1
                entry = int(codes[window >> 48])
                at += entry >> 8
                run, size = (entry & 255) >> 4, entry & 15
                if not size and run < 15:
                    run_on = (1 << run) + take(run)
                else:
                    fresh = (1 if take(1) else -1) if size else 0
                    left = run
            while k <= se:
                if row[k]:
                    if take(1) and not abs(int(row[k])) >> al & 1:
                        row[k] += (1 << al) if row[k] > 0 else -(1 << al)
                elif not run_on:
                    if not left:
                        if fresh:
                            row[k] = fresh << al if fresh > 0 else -(1 << al)
                        k += 1
                        break
                    left -= 1
                k += 1
        if run_on:
            run_on -= 1


def _read_ac_refined(bits: _Bits, at: np.ndarray, per: np.ndarray, blocks: np.ndarray, flat: np.ndarray, codes: np.ndarray, ss: int, se: int, al: int) -> None:
    """Intervals that are one end-of-band run give a bit to each coefficient known so far, all at once; others go symbol by
    symbol."""
    window = bits.peek(at)
    entry = codes[(window >> np.uint64(48)).astype(np.int64)]
    skip, symbol = entry >> 8, entry & 255
    run = symbol >> 4
    end = ((symbol & 15) == 0) & (run < 15)
    length = np.where(end, run, 0)
    covers = (1 << length) + ((window << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - length).astype(np.uint64)).astype(np.int64)
    whole = end & (covers >= per)
    first = np.cumsum(per) - per
    for i in np.flatnonzero(~whole):
        _refine_one(bits, int(at[i]), blocks[first[i] : first[i] + per[i]], flat, codes, ss, se, al)
    own = blocks[np.repeat(whole, per)]
    if not len(own):
        return
    rows = flat.reshape(-1, 64)[own, ss : se + 1]
    known = rows != 0
    sizes = per[whole]
    count = np.add.reduceat(known.sum(1), np.cumsum(sizes) - sizes)
    place = _ranges((at + skip + length)[whole], count)
    bit = (bits.bytes[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
    old = rows[known]
    rows[known] = old + np.sign(old) * (bit.astype(np.int64) << al)
    flat.reshape(-1, 64)[own, ss : se + 1] = rows


def read(streams: list[bytes]) -> tuple[np.ndarray, Grid, list[bytes]]:
    """(blocks, 64) coefficients in zigzag order (times the quantisation steps), their grid and the images' notes."""
    data = b"".join(streams)
    starts = np.cumsum([0, *map(len, streams)])[:-1].tolist()
    bits = _Bits(data)
    images = [_parse(data, at, bits.other) for at in starts]
    grid = Grid(np.array([x["across"] for x in images]), np.array([x["down"] for x in images]))
    flat = np.zeros(64 * grid.total, np.int64)
    look: dict[bytes, np.ndarray] = {}
    for nth in range(max(len(x["scans"]) for x in images)):
        groups = defaultdict(list)
        for i, x in enumerate(images):
            if nth < len(x["scans"]):
                groups[x["scans"][nth][2]].append(i)
        for (parts, ss, se, ah, al, table), own in groups.items():
            own = np.array(own)
            part = Grid(grid.across[own], grid.down[own])
            part.first = grid.first[own]
            blocks, kinds, per, _ = part.scan(parts)
            at = bits.intervals(np.array([images[i]["scans"][nth][0] for i in own]), np.array([images[i]["scans"][nth][1] for i in own]))
            if len(at) != len(per):
                raise ValueError("restart markers are missing")
            if table and table not in look:
                look[table] = _look_up(table)
            if ss == 0 and ah == 0:
                flat[64 * blocks] = _read_dc_first(bits, at, per, kinds, look[table]) << al
            elif ss == 0:
                place = _ranges(at, per)
                bit = (bits.bytes[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
                flat[64 * blocks] |= bit.astype(np.int64) << al
            elif ah == 0:
                _read_ac_first(bits, at, per, blocks, flat, look[table], ss, se, al)
            else:
                _read_ac_refined(bits, at, per, blocks, flat, look[table], ss, se, al)
    out = flat.reshape(-1, 64)
    steps = [np.frombuffer(x["quantum"], np.uint8).astype(np.int64) for x in images]
    if any((s != 1).any() for s in steps):
        out = out * np.repeat(np.array(steps), 6 * grid.mcus, axis=0)
    return out, grid, [x["note"] for x in images]


# ---------------------------------------------------------------- pixels

_FINE = 14


def _basis() -> np.ndarray:
    """(64 coefficients in zigzag order, 64 samples) of the inverse cosine transform, in 2**-_FINE. Whole numbers in doubles
    give exact sums, whatever their order."""
    n = np.arange(8)
    one = np.cos((2 * n[None] + 1) * n[:, None] * np.pi / 16) * np.where(n[:, None] == 0, 0.5**0.5, 1) / 2
    both = np.einsum("uy,vx->uvyx", one, one).reshape(64, 64)
    return np.rint(both[ZIGZAG] * (1 << _FINE))


BASIS = _basis()


def samples(coefficients: np.ndarray) -> np.ndarray:
    """(blocks, 8, 8) samples from 0 to 255."""
    x = coefficients.astype(np.float64) @ BASIS
    return np.clip(np.floor(x / (1 << _FINE) + 128.5), 0, 255).astype(np.int16).reshape(-1, 8, 8)


def mcu_pixels(coefficients: np.ndarray, grid: Grid) -> np.ndarray:
    """(MCUs, 16, 16, 3) RGB, chroma repeated over 2 by 2 pixels."""
    order = grid.mcu_order()
    y = samples(coefficients[order[:, :4].ravel()]).reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    cb = samples(coefficients[order[:, 4]]).astype(np.int32) - 128
    cr = samples(coefficients[order[:, 5]]).astype(np.int32) - 128
    half = 1 << 15
    shift = np.stack([(91881 * cr + half) >> 16, -((22554 * cb + 46802 * cr + half) >> 16), (116130 * cb + half) >> 16], -1).astype(np.int16)
    full = shift.repeat(2, 1).repeat(2, 2)
    full += y[..., None]
    return np.clip(full, 0, 255).astype(np.uint8)


def tensors(pixels: np.ndarray, grid: Grid) -> list[np.ndarray]:
    """(height, width, 3) of each image."""
    parts = np.split(pixels, np.cumsum(grid.mcus)[:-1])
    return [p.reshape(h, w, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16 * h, 16 * w, 3) for p, w, h in zip(parts, grid.across, grid.down)]
