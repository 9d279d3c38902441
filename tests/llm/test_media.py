import hashlib
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import media as M

TEXTS = [None, "", "a", "é" * 300, "x" * 576, "ÿ\x00€" * 1000, "a", "long text " * 20_000]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip_by_arrays_and_bit_by_bit(text, monkeypatch):
    _, payload = M.padded(text)
    made = M.encode(payload)
    height, width, comps, quantisers, comment = M.read_scans(made)
    assert M.payload_of(comps, comment) == payload
    if len(payload) < 5000:
        monkeypatch.setattr(M, "_whole", lambda *a: False)
        slow = M.read_scans(made)[2]
        assert all((a.coefficients == b.coefficients).all() for a, b in zip(comps, slow, strict=True))
    assert M.rgb_of(height, width, comps, quantisers).shape == (height, width, 3)


def test_all_bytes_survive():
    payload = np.random.default_rng(1).integers(0, 256, 576 * 41, dtype=np.uint8).tobytes() + b"\xff" * 576
    _, _, comps, _, comment = M.read_scans(M.encode(payload))
    assert M.payload_of(comps, comment) == payload


def test_inverse_transform_equals_the_formula():
    rng = np.random.default_rng(2)
    c = rng.integers(-50, 50, 64)
    plain = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            for k in range(64):
                v, u = divmod(int(M.ZIGZAG[k]), 8)
                scale = (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1) / 4
                plain[y, x] += scale * c[k] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    assert np.allclose((c.astype(np.float32) @ M.BASIS).reshape(8, 8), plain, atol=1e-2)


def write_sparse(y, cb, cr):
    """Another writer: 16 x 16 pixels, 4:2:0, interleaved DC, runs of zeros, end-of-band runs and refinement of zero and non-zero coefficients."""
    symbols = [x for x in range(255)]
    table = lambda kind: M._huffman(kind, 0, {8: symbols})
    code = {s: M._number(i, 8) for i, s in enumerate(symbols)}

    def signed(v):
        n = abs(v).bit_length()
        return n, M._number(v if v > 0 else v + (1 << n) - 1, n)

    out = [b"\xff\xd8", M.segment(0xDB, b"\0" + b"\1" * 64), M.segment(0xC2, struct.pack(">BHHB", 8, 16, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), table(0), table(1)]
    bits, planes = [], [y, cb, cr]
    for p in planes:
        before = 0
        for b in p:
            n, extra = signed((b[0] >> 1) - before)
            before = b[0] >> 1
            bits += code[n] + extra
    out.append(M.segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 1])) + M._bits(np.array(bits, np.uint8)))
    for ident, p in enumerate(planes, 1):
        bits, run = [], 0
        for b in [*p, None]:
            vals = [] if b is None else [int(np.sign(v)) * (abs(v) >> 1) for v in b[1:]]
            if b is None or any(vals):
                if run:
                    r = run.bit_length() - 1
                    bits += code[r << 4] + M._number(run - (1 << r), r)
                    run = 0
                zeros = 0
                for j, v in enumerate(vals):
                    if v == 0:
                        zeros += 1
                        continue
                    while zeros > 15:
                        bits += code[0xF0]
                        zeros -= 16
                    n, extra = signed(v)
                    bits += code[zeros << 4 | n] + extra
                    zeros = 0
                if b is not None and vals[-1] == 0:
                    run = 1
            else:
                run += 1
        out.append(M.segment(0xDA, bytes([1, ident, 0, 1, 63, 1])) + M._bits(np.array(bits, np.uint8)))
    out.append(M.segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 16])) + M._bits(np.array([b[0] & 1 for p in planes for b in p], np.uint8)))
    for ident, p in enumerate(planes, 1):
        bits = []
        for b in p:
            history = [abs(v) >> 1 for v in b[1:]]
            fresh = [j for j, v in enumerate(b[1:]) if abs(v) == 1]
            at = 0
            for j in fresh:
                while sum(h == 0 for h in history[at:j]) > 15:
                    k, zeros, fix = at, 0, []
                    while zeros < 16:
                        if history[k]:
                            fix.append(abs(b[1 + k]) & 1)
                        else:
                            zeros += 1
                        k += 1
                    bits += code[0xF0] + fix
                    at = k
                bits += code[sum(h == 0 for h in history[at:j]) << 4 | 1] + [int(b[1 + j] > 0)] + [abs(b[1 + k]) & 1 for k in range(at, j) if history[k]]
                at = j + 1
            if at < 63:
                bits += code[0] + [abs(b[1 + k]) & 1 for k in range(at, 63) if history[k]]
        out.append(M.segment(0xDA, bytes([1, ident, 0, 1, 63, 16])) + M._bits(np.array(bits, np.uint8)))
    return b"".join([*out, b"\xff\xd9"])


def test_sparse_interleaved_files_are_read_too():
    rng = np.random.default_rng(3)
    planes = [[[int(v) * int(rng.random() < p) for v in rng.integers(-9, 10, 64)] for _ in range(n)] for n, p in ((4, 0.2), (1, 0.03), (1, 0.9))]
    _, _, comps, _, _ = M.read_scans(write_sparse(*planes))
    for c, p in zip(comps, planes, strict=True):
        assert c.coefficients.tolist() == p


def test_query_columns(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "media") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in M.op9_media_jpeg(spark, str(tmp_path)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        p = b + b"\xff" * ((-len(b) % 576) or (0 if b else 576))
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert tuple(rows[2])[1:] == tuple(rows[6])[1:] and tuple(rows[0])[1:] == tuple(rows[1])[1:]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.read_media(M.store_texts(empty)).count() == 0


def test_the_query_stores_the_tensors(spark, tmp_path):
    rows = [(1, "abc" * 1000, "x"), (2, None, "x"), (2, None, "x"), (3, "é" * 5000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, rgb string").write.parquet(f"{tmp_path}/documents.parquet")
    M.op9_media_jpeg(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 4
    for r in got:
        rgb = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
        assert M.feature_of(rgb) == r["feature"]
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        height, width, comps, quantisers, _ = M.read_scans(M.encode(M.padded(text)[1]))
        assert (M.rgb_of(height, width, comps, quantisers) == rgb).all()


def test_a_payload_beyond_the_limit_is_refused():
    with pytest.raises(ValueError):
        M.geometry(M.MOST + 1)
    assert M.geometry(M.MOST)


def test_very_long_text():
    for text in ("é" * 1_000_000, " " * 3_000_000 + "a"):
        n, payload = M.padded(text)
        height, width, comps, quantisers, comment = M.read_scans(M.encode(payload))
        assert M.payload_of(comps, comment)[:n].decode() == text
        assert M.rgb_of(height, width, comps, quantisers).shape == (height, width, 3)
