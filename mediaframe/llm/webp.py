"""Lossless WebP (VP8L): a decoder for whole images and an encoder for 8-bit samples, in numpy.

The decoder reads many images in step: each step gives every image one pixel, from a literal, the colour cache or a
back-reference, with prefix codes as tables over the next 15 bits. Transforms (predictor, cross-colour, subtract green,
palette) are inverted afterwards, image by image.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
#: Near pixels by distance code: 8 columns either way and 7 rows up, by distance, then column offset, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

WIDTH, ROWS = 64, 64  # of the images that the encoder makes of samples
CACHE_BITS = 9
LOOK = 15


# Prefix codes


def code_lengths(weights: list[int], limit: int) -> list[int]:
    """Huffman code lengths, 0 for weight 0; weights are flattened until no length is over limit."""
    floor = 0
    while True:
        heap = [(max(w, floor), i, (i,)) for i, w in enumerate(weights) if w]
        out = [0] * len(weights)
        if len(heap) == 1:
            out[heap[0][1]] = 1
            return out
        heapq.heapify(heap)
        n = len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            n += 1
            heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
        if max(out) <= limit:
            return out
        floor = floor * 2 or max(1, sum(weights) >> limit)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes with their first bit lowest, as they stand in the stream."""
    out = np.zeros(len(lengths), np.int64)
    code, last = 0, 0
    for s in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        out[s] = int(f"{code:0{last}b}"[::-1], 2)
        code += 1
    return out


@lru_cache(maxsize=512)
def table(lengths: bytes) -> np.ndarray:
    """length << 16 | symbol for each value of the next 15 bits; a lone symbol takes no bits."""
    n = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(n)
    if len(used) <= 1:
        return np.full(1 << LOOK, int(used[0]) if len(used) else 0, np.int32)
    if sum(1 << (LOOK - int(x)) for x in n[used]) != 1 << LOOK:
        raise ValueError("a prefix code is not complete")
    out, codes = np.zeros(1 << LOOK, np.int32), canonical(n)
    for s in used.tolist():
        out[codes[s] :: 1 << int(n[s])] = int(n[s]) << 16 | s
    return out


class BitWriter:
    def __init__(self) -> None:
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def code(self, lengths: list[int]) -> None:
        """A prefix code: one symbol below 256 as a simple code, others as run-length coded lengths."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) == 1 and used[0] < 256:
            self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(used[0], 8)
            return
        items, i = [], 0
        while i < len(lengths):
            j = i
            while j < len(lengths) and lengths[j] == lengths[i]:
                j += 1
            n, v = j - i, lengths[i]
            if v:
                items.append((v, 0, 0))
                n -= 1
            while n:
                if v and n >= 3:
                    k = min(n, 6)
                    items.append((16, k - 3, 2))
                elif not v and n >= 3:
                    k = min(n, 138)
                    items.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
                else:
                    k = 1
                    items.append((v, 0, 0))
                n -= k
            i = j
        weights = [0] * 19
        for s, _, _ in items:
            weights[s] += 1
        cl = code_lengths(weights, 7)
        lone = sum(n > 0 for n in cl) == 1
        codes = canonical(np.array(cl))
        self.put(0, 1), self.put(15, 4)
        for s in CODE_LENGTH_ORDER:
            self.put(cl[s], 3)
        self.put(0, 1)
        for s, extra, n in items:
            if not lone:
                self.put(int(codes[s]), cl[s])
            self.put(extra, n)

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


class BitReader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def get(self, n: int) -> int:
        i = self.at >> 3
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        v = int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)
        self.at += n
        return v & ((1 << n) - 1)

    def symbol(self, look: np.ndarray) -> int:
        i = self.at >> 3
        v = int.from_bytes(self.data[i : i + 4], "little") >> (self.at & 7)
        e = int(look[v & 0x7FFF])
        self.at += e >> 16
        return e & 0xFFFF

    def code(self, size: int) -> bytes:
        """The lengths of a prefix code over size symbols."""
        out = bytearray(size)
        if self.get(1):
            two, wide = self.get(1), self.get(1)
            for s in [self.get(8 if wide else 1)] + ([self.get(8)] if two else []):
                out[s] = 1
            return bytes(out)
        cl = bytearray(19)
        for s in CODE_LENGTH_ORDER[: 4 + self.get(4)]:
            cl[s] = self.get(3)
        left = 2 + self.get(2 + 2 * self.get(3)) if self.get(1) else size
        look, i, last = table(bytes(cl)), 0, 8
        while i < size and left:
            left -= 1
            s = self.symbol(look)
            if s < 16:
                out[i] = s
                last = s or last
                i += 1
            else:
                v, n = (last, 3 + self.get(2)) if s == 16 else (0, 3 + self.get(3)) if s == 17 else (0, 11 + self.get(7))
                if i + n > size:
                    raise ValueError("code lengths run over")
                out[i : i + n] = bytes([v]) * n
                i += n
        return bytes(out)


# Decoding


class Image:
    """One image on its way: size, transforms, codes, and where its pixels' bits begin."""

    def __init__(self, width: int, height: int) -> None:
        self.width, self.height, self.transforms = width, height, []
        self.cache_bits, self.meta, self.meta_bits, self.groups = 0, None, 0, []


def _sub(n: int, bits: int) -> int:
    return -(-n >> bits)


def _read_codes(r: BitReader, image: Image, main: bool) -> None:
    image.cache_bits = r.get(4) if r.get(1) else 0
    n = 1
    if main and r.get(1):
        image.meta_bits = r.get(3) + 2
        m = _read_image(r, _sub(image.width, image.meta_bits), _sub(image.height, image.meta_bits))
        image.meta = (m >> 8 & 0xFFFF).astype(np.int64)
        n = int(image.meta.max()) + 1
    cache = 1 << image.cache_bits if image.cache_bits else 0
    image.groups = [tuple(r.code(s) for s in (280 + cache, 256, 256, 256, 40)) for _ in range(n)]


def _read_image(r: BitReader, width: int, height: int) -> np.ndarray:
    """A transform's own image."""
    image = Image(width, height)
    _read_codes(r, image, False)
    pixels, ends = _pixels([image], r.data, np.array([r.at]))
    r.at = int(ends[0])
    return pixels[0].reshape(height, width)


def _open(r: BitReader, width: int, height: int) -> Image:
    image = Image(width, height)
    while r.get(1):
        kind = r.get(2)
        if kind in {k for k, *_ in image.transforms}:
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOR):
            bits = r.get(3) + 2
            image.transforms.append((kind, image.width, bits, _read_image(r, _sub(image.width, bits), _sub(height, bits))))
        elif kind == SUBTRACT_GREEN:
            image.transforms.append((kind, image.width, 0, None))
        else:
            n = r.get(8) + 1
            colors = np.cumsum(_read_image(r, n, 1)[0].view(np.uint8).reshape(-1, 4), 0, dtype=np.uint8).view(np.uint32)[:, 0]
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            image.transforms.append((kind, image.width, bits, colors))
            image.width = _sub(image.width, bits)
    _read_codes(r, image, True)
    return image


def _pixels(images: list[Image], data: bytes, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The coded pixels of images whose bits begin at the bit positions at of data, and where they end."""
    words = np.frombuffer(data + bytes(24 - len(data) % 8), np.uint64)
    size = np.array([i.width * i.height for i in images])
    order = np.argsort(-size, kind="stable")
    images, at, size = [images[i] for i in order], at[order].astype(np.int64), size[order]
    sets: dict[tuple, int] = {}
    first = np.array([[sets.setdefault(g, len(sets)) for g in i.groups][0] for i in images])
    looks = [np.stack([table(g[k]) for g in sets]) for k in range(5)]
    one = len(sets) == 1
    metas = [(k, i) for k, i in enumerate(images) if i.meta is not None]
    numbers = {k: np.array([sets[g] for g in i.groups]) for k, i in metas}
    width = np.array([i.width for i in images])
    bits = np.array([i.cache_bits for i in images])
    cached = bits > 0
    start = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(start[-1], np.uint32)
    caches = np.zeros((len(images), 1 << int(bits.max())), np.uint32) if cached.any() else None
    shift = (32 - bits).astype(np.uint32)
    left, back = np.zeros(len(images), np.int64), np.ones(len(images), np.int64)
    mask, live = np.uint64(0x7FFF), len(images)
    ends = np.zeros(len(images), np.int64)
    lanes = np.arange(len(images))
    near = np.array([(0, 0), *NEAR])

    def extra(v: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.where(prefix < 4, 0, (prefix - 2) >> 1)
        base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << n)
        return base + (v & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64) + 1, n

    for step in range(int(size[0]) if len(size) else 0):
        while live and size[live - 1] <= step:
            live -= 1
        read = np.flatnonzero(left[:live] == 0) if left[:live].any() else lanes[:live]
        if len(read):
            whole = len(read) == live
            p = at[:live] if whole else at[read]
            w, s = p >> 6, (p & 63).astype(np.uint64)
            v = (words[w] >> s) | ((words[w + 1] << (np.uint64(63) - s)) << np.uint64(1))
            t = None
            if not one:
                t = first[read]
                for k, i in metas:
                    if k < live and left[k] == 0:
                        t[np.searchsorted(read, k)] = numbers[k][i.meta[step // i.width >> i.meta_bits, step % i.width >> i.meta_bits]]
            pick = (lambda k, x: looks[k][0][(x & mask).astype(np.int64)]) if one else (lambda k, x, t=t: looks[k][t, (x & mask).astype(np.int64)])
            g = pick(0, v)
            n0 = (g >> 16).astype(np.uint64)
            g &= 0xFFFF
            x = v >> n0
            red = pick(1, x)
            n = (red >> 16).astype(np.uint64)
            x = x >> n
            used = n0 + n
            blue = pick(2, x)
            n = (blue >> 16).astype(np.uint64)
            x = x >> n
            used += n
            alpha = pick(3, x)
            used += (alpha >> 16).astype(np.uint64)
            pixel = (alpha & 0xFF).astype(np.uint32) << np.uint32(24) | (red & 0xFF).astype(np.uint32) << np.uint32(16) | (g & 0xFF).astype(np.uint32) << np.uint32(8) | (blue & 0xFF).astype(np.uint32)
            other = g >= 256
            if other.any():
                hit = np.flatnonzero(g >= 280)
                if len(hit):
                    used[hit] = n0[hit]
                    pixel[hit] = caches[read[hit], g[hit] - 280]
                ref = np.flatnonzero(other & (g < 280))
                if len(ref):
                    x = v[ref] >> n0[ref]
                    length, n = extra(x, g[ref].astype(np.int64) - 256)
                    x = x >> n.astype(np.uint64)
                    d = looks[4][0][(x & mask).astype(np.int64)] if one else looks[4][t[ref], (x & mask).astype(np.int64)]
                    dist, m = extra(x >> (d >> 16).astype(np.uint64), (d & 0xFFFF).astype(np.int64))
                    used[ref] = n0[ref] + (n + (d >> 16) + m).astype(np.uint64)
                    lane = read[ref]
                    is_near = dist <= 120
                    xy = near[np.where(is_near, dist, 0)]
                    dist = np.where(is_near, np.maximum(1, xy[:, 0] + xy[:, 1] * width[lane]), dist - 120)
                    if (dist > step).any() or (length > size[lane] - step).any():
                        raise ValueError("a back-reference leaves the image")
                    left[lane], back[lane] = length, dist
            if whole:
                at[:live] += used.astype(np.int64)
                out[start[:live] + step] = pixel
            else:
                at[read] += used.astype(np.int64)
                out[start[read] + step] = pixel
        copy = np.flatnonzero(left[:live])
        if len(copy):
            to = start[copy] + step
            out[to] = out[to - back[copy]]
            left[copy] -= 1
        if caches is not None:
            now = lanes[:live] if cached[:live].all() else np.flatnonzero(cached[:live])
            px = out[start[now] + step]
            caches[now, (px * np.uint32(CACHE_MULTIPLIER)) >> shift[now]] = px
    ends[order] = at
    if (at > 8 * len(data)).any():
        raise ValueError("the stream ends early")
    back_order = np.argsort(order)
    return [out[start[k] : start[k + 1]] for k in back_order], ends


def _channels(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p).view(np.uint8).reshape(*p.shape, 4).astype(np.int32)  # blue, green, red, alpha


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The predicted pixel (channels along the last axis) from those to the left, above, above right and above left."""
    if mode in (0, 14, 15):
        return np.zeros_like(left) + np.array([0, 0, 0, 255])
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode <= 10:
        lt, lc, tr, ct = (left + top) >> 1, (left + corner) >> 1, (top + right) >> 1, (corner + top) >> 1
        return ((((left + right) >> 1) + top) >> 1, lc, lt, ct, tr, (lc + tr) >> 1)[mode - 5]
    if mode == 11:
        closer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(closer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = (left + top) >> 1
    return np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int32), 0, 255)


def _modes(image: np.ndarray) -> np.ndarray:
    return image >> 8 & 15


def _undo_predictor(p: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    c = _channels(p)
    h, w = p.shape
    for y in range(h):
        for x in range(w):
            if not y:
                guess = c[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif not x:
                guess = c[y - 1, 0]
            else:
                guess = predict(int(modes[y >> bits, x >> bits]), c[y, x - 1], c[y - 1, x], c[y - 1, x + 1] if x + 1 < w else c[y, 0], c[y - 1, x - 1])
            c[y, x] = (c[y, x] + guess) & 255
    return c.astype(np.uint8).view(np.uint32)[..., 0]


def _cross(c: np.ndarray, bits: int, image: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) what green, and red, tell of red and blue."""
    h, w = c.shape[:2]
    e = image.view(np.int8).reshape(*image.shape, 4).astype(np.int32)[np.arange(h)[:, None] >> bits, np.arange(w)[None] >> bits]
    signed = lambda a: ((a & 255) ^ 128) - 128
    green = signed(c[..., 1])
    red = c[..., 2] + sign * (e[..., 0] * green >> 5)
    true_red = red if sign > 0 else c[..., 2]
    blue = c[..., 0] + sign * (e[..., 1] * green >> 5) + sign * (e[..., 2] * signed(true_red) >> 5)
    out = c.copy()
    out[..., 2], out[..., 0] = red & 255, blue & 255
    return out


def _finish(image: Image, p: np.ndarray) -> np.ndarray:
    p = p.reshape(image.height, image.width)
    for kind, width, bits, extra in reversed(image.transforms):
        if kind == PREDICTOR:
            p = _undo_predictor(p, bits, _modes(extra))
        elif kind == PALETTE:
            index = (p >> 8 & 255).astype(np.int64)
            if bits:
                per, depth = 1 << bits, 8 >> bits
                index = (index[..., None] >> (np.arange(per) * depth) & ((1 << depth) - 1)).reshape(image.height, -1)[:, :width]
            colors = np.concatenate((extra, np.zeros(256, np.uint32)))
            p = colors[index]
        else:
            c = _channels(p)
            if kind == CROSS_COLOR:
                c = _cross(c, bits, extra, 1)
            else:
                c[..., (0, 2)] = (c[..., (0, 2)] + c[..., 1:2]) & 255
            p = c.astype(np.uint8).view(np.uint32)[..., 0]
    return p


class Decoder:
    """Decodes files; prefix codes that were read once are known again by their bits."""

    def __init__(self) -> None:
        self.known: dict[int, dict[bytes, Image]] = {}

    def _open(self, body: bytes) -> tuple[Image, int]:
        """The image and the bit at which its pixels begin, of a chunk's content."""
        if len(body) < 6 or body[0] != SIGNATURE:
            raise ValueError("not a lossless WebP image")
        head = int.from_bytes(body[1:5], "little")
        if head >> 29:
            raise ValueError("unknown version")
        width, height = (head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1
        for n, seen in self.known.items():
            k = 5 + n // 8
            found = seen.get(body[5:k] + bytes([body[k] & ((1 << n % 8) - 1)])) if len(body) > k else None
            if found:
                image = Image(width, height)
                image.cache_bits, image.groups = found.cache_bits, found.groups
                return image, 40 + n
        r = BitReader(body, 40)
        image = _open(r, width, height)
        n, k = r.at - 40, r.at // 8
        if not image.transforms and image.meta is None and len(self.known) < 8 and k < len(body):
            self.known.setdefault(n, {})[body[5:k] + bytes([body[k] & ((1 << n % 8) - 1)])] = image
        return image, r.at

    def decode(self, files: list[bytes], at_once: int = 64) -> list[np.ndarray]:
        """ARGB pixels (uint32, by rows and columns) of each file; at most at_once different sets of codes are held as tables."""
        found = []
        for f in files:
            if f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L":
                raise ValueError("not a lossless WebP file")
            body = f[20 : 20 + int.from_bytes(f[16:20], "little")]
            found.append((*self._open(body), body))
        out: list[np.ndarray] = []
        i = 0
        while i < len(found):
            sets, j = set(), i
            while j < len(found) and len(sets | {*found[j][0].groups}) <= max(at_once, len(found[j][0].groups)):
                sets |= {*found[j][0].groups}
                j += 1
            part, starts, bodies, n = found[i:j], [], [], 0
            for _, at, body in part:
                starts.append(8 * n + at)
                bodies.append(body)
                n += len(body)
            raw, ends = _pixels([x for x, _, _ in part], b"".join(bodies), np.array(starts))
            for (image, at, body), start, end, p in zip(part, starts, ends.tolist(), raw, strict=True):
                if end - start + at > 8 * len(body):
                    raise ValueError("the stream ends early")
                out.append(_finish(image, p))
            i = j
        return out


def split_files(data: bytes) -> list[bytes]:
    """The files of a sequence of WebP files that follow each other."""
    out, i = [], 0
    while i < len(data):
        n = 8 + int.from_bytes(data[i + 4 : i + 8], "little")
        out.append(data[i : i + n])
        i += n
    return out


# Encoding


def _literal_weights() -> list[int]:
    """How often a byte of text is taken to occur: blanks, then small letters, then printable signs, then the rest."""
    return [640 if b == 32 else 96 if 97 <= b <= 122 else 8 if 33 <= b <= 126 or b == 10 else 6 if b >= 128 else 1 for b in range(256)]


def _flat(size: int) -> list[int]:
    return [8] * 256 + [0] * (size - 256)


@lru_cache(maxsize=1)
def _plain() -> tuple:
    """The bits before the pixels of a plain image, and lengths and codes of green (with runs and cache), and of red and blue."""
    literal = _literal_weights()
    green, other = code_lengths(literal + [4] * 24 + [4] * (1 << CACHE_BITS), LOOK), code_lengths(literal, LOOK)
    w = BitWriter()
    w.put(0, 1), w.put(1, 1), w.put(CACHE_BITS, 4), w.put(0, 1)
    for c in (green, other, other, [0] * 255 + [1], [0, 1] + [0] * 38):  # alpha is always 255; runs repeat the pixel before (distance code 2)
        w.code(c)
    g, o = np.array(green), np.array(other)
    return w.value, w.n, g.astype(np.uint64), canonical(g).astype(np.uint64), o.astype(np.uint64), canonical(o).astype(np.uint64)


def _file(body: bytes) -> bytes:
    pad = len(body) % 2
    return struct.pack("<4sI8sI", b"RIFF", 12 + len(body) + pad, b"WEBPVP8L", len(body)) + body + bytes(pad)


def _head(width: int, height: int, alpha: int = 0) -> bytes:
    return bytes([SIGNATURE]) + ((width - 1) | (height - 1) << 14 | alpha << 28).to_bytes(4, "little")


def _put_flat(w: BitWriter, pixels: np.ndarray, main: bool) -> None:
    """Pixels with codes of 8 bits for every channel."""
    w.put(0, 1)
    if main:
        w.put(0, 1)
    for size in (280, 256, 256, 256):
        w.code(_flat(size))
    w.code([1] + [0] * 39)
    c = canonical(np.array(_flat(256)))
    for b, g, r, a in _channels(pixels.reshape(-1)).tolist():
        for v in (g, r, b, a):
            w.put(int(c[v]), 8)


def encode_with_transforms(pixels: np.ndarray, transforms: list[tuple]) -> bytes:
    """A file of any ARGB pixels. transforms, in the order in which they are applied: (PREDICTOR, bits, modes), (CROSS_COLOR, bits, elements as pixels), (SUBTRACT_GREEN,), (PALETTE,), the last at most once and last."""
    h, width = pixels.shape
    w, p = BitWriter(), np.ascontiguousarray(pixels, np.uint32)
    for kind, *how in transforms:
        w.put(1, 1), w.put(kind, 2)
        c = _channels(p)
        if kind == PREDICTOR:
            bits, modes = how
            w.put(bits - 2, 3)
            _put_flat(w, (np.asarray(modes).astype(np.uint32) << np.uint32(8)), False)
            guess = np.zeros_like(c)
            guess[0, 0] = (0, 0, 0, 255)
            guess[0, 1:], guess[1:, 0] = c[0, :-1], c[:-1, 0]
            for y in range(1, h):
                for x in range(1, p.shape[1]):
                    guess[y, x] = predict(int(modes[y >> bits, x >> bits]), c[y, x - 1], c[y - 1, x], c[y - 1, x + 1] if x + 1 < p.shape[1] else c[y, 0], c[y - 1, x - 1])
            p = ((c - guess) & 255).astype(np.uint8).view(np.uint32)[..., 0]
        elif kind == CROSS_COLOR:
            bits, elements = how
            w.put(bits - 2, 3)
            _put_flat(w, elements, False)
            p = _cross(c, bits, np.ascontiguousarray(elements, np.uint32), -1).astype(np.uint8).view(np.uint32)[..., 0]
        elif kind == SUBTRACT_GREEN:
            c[..., (0, 2)] = (c[..., (0, 2)] - c[..., 1:2]) & 255
            p = c.astype(np.uint8).view(np.uint32)[..., 0]
        else:
            colors, index = np.unique(p, return_inverse=True)
            n = len(colors)
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            w.put(n - 1, 8)
            steps = np.diff(_channels(colors), axis=0, prepend=np.zeros((1, 4), np.int32)) & 255
            _put_flat(w, steps.astype(np.uint8).view(np.uint32)[..., 0], False)
            index = index.reshape(p.shape)
            per, depth = 1 << bits, 8 >> bits
            index = np.pad(index, ((0, 0), (0, -p.shape[1] % per))).reshape(h, -1, per)
            p = ((index << (np.arange(per) * depth)).sum(-1).astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
    w.put(0, 1)
    _put_flat(w, p, True)
    return _file(_head(width, h, int((pixels >> 24 != 255).any())) + w.bytes())


def encode_samples(payloads: list[np.ndarray]) -> list[bytes]:
    """For each payload (bytes, a positive multiple of 192) its files, one after another: images of 64 columns and up to 64 rows of three samples a pixel.

    Images of at most 16 colours get a palette; others literals, runs and the colour cache under fixed codes. Equal
    payloads give equal bytes.
    """
    bits0, n0, glen, gcode, olen, ocode = _plain()
    span = 3 * WIDTH * ROWS
    parts = [(k, p[i : i + span]) for k, p in enumerate(payloads) for i in range(0, len(p), span)]
    if not parts:
        return []
    raw = np.concatenate([p for _, p in parts]).reshape(-1, 3).astype(np.uint32)
    px = np.uint32(0xFF000000) | raw[:, 0] << np.uint32(16) | raw[:, 1] << np.uint32(8) | raw[:, 2]
    size = np.array([len(p) // 3 for _, p in parts])
    lane = np.repeat(np.arange(len(parts)), size)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(px)) - first[lane]
    same = np.zeros(len(px), bool)
    same[1:] = (px[1:] == px[:-1]) & (place[1:] > 0)
    head = np.flatnonzero(~same)
    run = np.diff(np.append(head, len(px))) - 1  # repeats after each head
    long = run >= 4
    covered = np.zeros(len(px) + 1, np.int32)
    np.add.at(covered, head[long] + 1, 1)
    np.add.at(covered, (head + run + 1)[long], -1)
    covered = np.cumsum(covered[:-1]) > 0
    hashes = (px * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - CACHE_BITS)
    key = lane.astype(np.int64) << CACHE_BITS | hashes
    order = np.argsort(key, kind="stable")
    hit = np.zeros(len(px), bool)
    hit[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (px[order[1:]] == px[order[:-1]])
    at = np.flatnonzero(~covered)
    r, g, b = raw[at, 0], raw[at, 1], raw[at, 2]
    h = hit[at]
    n_lit = glen[g] + olen[r] + olen[b]
    v_lit = gcode[g] | ocode[r] << glen[g] | ocode[b] << (glen[g] + olen[r])
    sym = 280 + hashes[at].astype(np.int64)
    n_bits = np.where(h, glen[sym], n_lit)
    value = np.where(h, gcode[sym], v_lit)
    where = at.astype(np.float64)
    back = run[long]
    e = np.maximum(0, np.log2(np.maximum(back - 1, 1)).astype(np.int64) - 1)
    prefix = np.where(back <= 4, back - 1, 2 * e + 2 + ((back - 1) >> e & 1))
    e = np.where(back <= 4, 0, e)
    n_ref = glen[256 + prefix] + e.astype(np.uint64)
    v_ref = gcode[256 + prefix] | ((back - 1) & ((1 << e) - 1)).astype(np.uint64) << glen[256 + prefix]
    merged = np.argsort(np.concatenate((where, head[long] + 0.5)), kind="stable")
    n_bits, value = np.concatenate((n_bits, n_ref))[merged].astype(np.int64), np.concatenate((value, v_ref))[merged]
    of = np.concatenate((lane[at], lane[head[long]]))[merged]
    total = np.bincount(of, n_bits, minlength=len(parts)).astype(np.int64) + n0
    room = (total + 7) // 8 + 8
    room += -room % 8
    start = np.concatenate(([0], np.cumsum(room)))
    ahead = np.concatenate(([0], np.cumsum(n_bits)[:-1]))
    begins = np.searchsorted(of, np.arange(len(parts)))
    pos = ahead - ahead[begins][of] + 8 * start[:-1][of] + n0
    words = np.zeros(start[-1] // 8 + 1, np.uint64)
    w, s = pos >> 6, (pos & 63).astype(np.uint64)
    for index, bits in ((w, value << s), (w + 1, (value >> (np.uint64(63) - s)) >> np.uint64(1))):
        edge = np.flatnonzero(np.diff(index, prepend=-1))
        words[index[edge]] |= np.bitwise_or.reduceat(bits, edge)
    stream = words.view(np.uint8)
    prefix_bytes = bits0.to_bytes(n0 // 8 + 1, "little")
    fixed = np.frombuffer(prefix_bytes, np.uint8)
    out: list[list[bytes]] = [[] for _ in payloads]
    few = np.add.reduceat(~hit & ~same, first) <= 64  # an image of at most 16 colours misses the cache seldom
    for i, (k, p) in enumerate(parts):
        pixels = px[first[i] : first[i] + size[i]]
        if few[i] and len(np.unique(pixels)) <= 16:
            out[k].append(encode_with_transforms(pixels.reshape(-1, WIDTH), [(PALETTE,)]))
            continue
        body = stream[start[i] : start[i] + (int(total[i]) + 7) // 8]
        body[: len(fixed)] |= fixed
        out[k].append(_file(_head(WIDTH, len(p) // (3 * WIDTH)) + body.tobytes()))
    return [b"".join(x) for x in out]
