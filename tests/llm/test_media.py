import hashlib
import zlib

import numpy as np
import pytest

from mediaframe.llm import media, webp

R = np.random.default_rng(11)
TEXTS = ["", None, "a", "x" * 191, "x" * 192, "y" * 193, "hello wörld " * 3000, "".join(chr(c) for c in R.integers(32, 1000, 20_000)), "the of and " * 20, "abcdefghij" * 2000]


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "n")], "doc_id long, text string, pixel string")
    rows = media.decode_media(media.encode_media(df)).collect()
    assert len(rows) == len(TEXTS) + 1 and len({r.media for r in rows if r.doc_id == 6}) == 1
    for r in rows:
        t = (TEXTS[r.doc_id] or "").encode()
        assert r.n_bytes == len(t) and bytes(r.pixels) == t + b" " * (max(192, len(t) + -len(t) % 192) - len(t))
    assert media.decode_media(media.encode_media(df.limit(0))).count() == 0


def test_query_digests(spark):
    from mediaframe.llm.queries import op3_media

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op3_media(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        p = t + b" " * (max(192, len(t) + -len(t) % 192) - len(t))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


def _image(h, w, kind):
    if kind == "noise":
        return R.integers(0, 2**32, (h, w), dtype=np.uint32)
    y, x = np.mgrid[:h, :w]
    return (0xFF000000 | ((x * 3 + y) % 256) << 16 | ((x + y * 2) % 256) << 8 | (x * y) % 256).astype(np.uint32)


@pytest.mark.parametrize("kind", ["noise", "slope"])
def test_transforms(kind):
    h, w = 21, 37
    p = _image(h, w, kind)
    modes = np.arange(6 * 10).reshape(6, 10) % 14
    elements = R.integers(0, 2**24, (3, 5), dtype=np.uint32) | np.uint32(0xFF000000)
    steps = {"p": (webp.PREDICTOR, 2, modes), "c": (webp.CROSS_COLOR, 3, elements), "g": (webp.SUBTRACT_GREEN,)}
    for names in ("", "p", "c", "g", "pcg", "gcp", "cp"):
        f = webp.encode_with_transforms(p, [steps[n] for n in names])
        assert (webp.Decoder().decode([f])[0] == p).all(), names


@pytest.mark.parametrize("n", [1, 2, 4, 7, 16, 17, 200])
def test_palettes(n):
    p = R.choice(R.integers(0, 2**32, n, dtype=np.uint32), (9, 13))
    assert (webp.Decoder().decode([webp.encode_with_transforms(p, [(webp.PALETTE,)])])[0] == p).all()


def _written(width, height, items, cache_bits, meta=None):
    """A stream written item by item: ('lit', argb), ('ref', length, distance code), ('hit', index); the second group's codes have other lengths."""
    w = webp.BitWriter()
    w.put(0, 1), w.put(1, 1), w.put(cache_bits, 4)
    w.put(1 if meta is not None else 0, 1)
    if meta is not None:
        w.put(0, 3)
        webp._put_flat(w, (meta.astype(np.uint32) << np.uint32(8)), False)
    groups = []
    for k in range(1 if meta is None else int(meta.max()) + 1):
        weights = R.integers(1, 50, 280 + (1 << cache_bits)).tolist()
        g = [webp.code_lengths(weights, 15), *(webp.code_lengths(R.integers(1, 9, 256).tolist(), 15) for _ in range(3)), webp.code_lengths([1] * 40, 15)]
        groups.append([(n, webp.canonical(np.array(n))) for n in g])
        for n in g:
            w.code(n)

    def prefix(v):
        if v <= 4:
            return v - 1, 0, 0
        e = (v - 1).bit_length() - 2
        return 2 * e + 2 + ((v - 1) >> e & 1), e, (v - 1) & ((1 << e) - 1)

    out, cache = [], [0] * (1 << cache_bits)
    for kind, *x in items:
        g = groups[0 if meta is None else int(meta[len(out) // width >> 2, len(out) % width >> 2])]
        put = lambda k, s, g=g: w.put(int(g[k][1][s]), g[k][0][s])
        if kind == "lit":
            for k, s in enumerate((x[0] >> 8 & 255, x[0] >> 16 & 255, x[0] & 255, x[0] >> 24)):
                put(k, s)
            new = [x[0]]
        elif kind == "hit":
            put(0, 280 + x[0])
            new = [cache[x[0]]]
        else:
            n, code = x
            s, e, v = prefix(n)
            put(0, 256 + s), w.put(v, e)
            s, e, v = prefix(code)
            put(4, s), w.put(v, e)
            d = max(1, webp.NEAR[code - 1][0] + webp.NEAR[code - 1][1] * width) if code <= 120 else code - 120
            new = []
            for _ in range(n):
                new.append((out + new)[-d])
        for p in new:
            cache[(p * webp.CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        out += new
    assert len(out) == width * height
    return webp._file(webp._head(width, height, 1) + w.bytes()), np.array(out, np.uint32).reshape(height, width)


def _items(n):
    items, k = [], 0
    while k < n:
        kind = R.choice(["lit", "ref", "hit"]) if k > 30 else "lit"
        if kind == "ref":
            m = int(min(n - k, R.integers(1, 40)))
            code = int(R.choice([1, 2, 3, 121, 120 + R.integers(1, k), R.integers(1, 40)]))
            x, y = webp.NEAR[code - 1] if code <= 120 else (code - 120, 0)
            if max(1, x + y * 16) > k:
                continue
            items.append(("ref", m, code))
            k += m
        else:
            items.append(("lit", int(R.integers(0, 2**32))) if kind == "lit" else ("hit", int(R.integers(0, 16))))
            k += 1
    return items


def test_back_references_cache_and_meta_codes():
    files, want = [], []
    for i in range(12):
        meta = R.integers(0, 3, (3, 4)) if i % 2 else None
        f, p = _written(16, 12, _items(192), 4, meta)
        files.append(f)
        want.append(p)
    for at_once in (1, 5, 64):
        got = webp.Decoder().decode(files, at_once)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_near_pixels_are_in_the_format_s_order():
    assert webp.NEAR[:10] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1)] and len(webp.NEAR) == 120 and webp.NEAR[-1] == (8, 7)


def test_broken_files_are_refused():
    f = webp.encode_samples([np.arange(192, dtype=np.uint8)])[0]
    for bad in (b"RIFX" + f[4:], f[:20] + b"\0" + f[21:], f[:16] + (20).to_bytes(4, "little") + f[20:40]):
        with pytest.raises(ValueError):
            webp.Decoder().decode([bad])


def test_columns_named_like_added_ones_give_way(spark):
    d = spark.createDataFrame([(1, "ab", "x", 9, "y", b"z"), (None, None, None, None, None, None)], "doc_id long, text string, Media string, n_bytes int, feature string, pixels binary")
    stored = media.encode_media(d)
    assert stored.columns == ["doc_id", "feature", "pixels", "media", "n_bytes"]
    read = media.decode_media(stored)
    assert read.columns == ["doc_id", "media", "n_bytes", "pixels", "feature"]
    assert sorted((r.n_bytes, bytes(r.pixels)) for r in read.collect()) == [(0, b" " * 192), (2, b"ab" + b" " * 190)]
