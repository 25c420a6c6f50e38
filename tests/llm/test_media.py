import numpy as np

from txloom.llm import media as M


def picture(rng, h=120, w=140):
    a = rng.random((h // 4, w // 4))
    return np.clip(np.kron(a, np.ones((4, 4))) * 255, 0, 255).astype(np.uint8)


def test_copies_crops_and_edits_are_found_and_others_left_alone(spark):
    rng = np.random.default_rng(5)
    base = [picture(rng) for _ in range(12)]
    rows = [(i, a) for i, a in enumerate(base)]
    rows += [(100, base[0]), (101, base[1][17:, 23:]), (102, np.clip(base[2].astype(int) + 12, 0, 255).astype(np.uint8)), (103, base[3][:90, :100])]
    edited = base[4].copy()
    edited[:40, :50] = 0
    rows.append((104, edited))
    data = [(i, int(a.shape[1]), bytearray(a.tobytes()), "x") for i, a in rows]
    data += [(200, 10, None, "x"), (201, 10, bytearray(), "x"), (202, 0, bytearray(b"abc"), "x"), (203, 4, bytearray(16), "x"), (None, 4, bytearray(16), "x"), data[0]]
    df = spark.createDataFrame(data, "id long, width int, pixels binary, bits string")
    got = {r["id"]: (r["copy_of"], r["n_features"]) for r in M.copies(df).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: i for i in [*range(12), 200, 201, 202, 203]} | {100: 0, 101: 1, 102: 2, 103: 3, 104: 4}
    assert got[0][1] > 20 and got[200][1] == 0
    assert M.copies(df.limit(0)).count() == 0


def test_descriptors_turn_with_the_image():
    rng = np.random.default_rng(8)
    a = picture(rng, 80, 80)
    own, turned = ({f[3] for f in M.features(x) if f[0] == 0} for x in (a, np.rot90(a).copy()))
    near = sum(any(bin((x ^ y) & (1 << 64) - 1).count("1") <= 12 for y in turned) for x in own)
    assert near >= 0.5 * len(own)


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    """Images whose every table entry is owned by an unrelated smaller id, among random ones, against brute force."""
    rng = np.random.default_rng(3)
    kinds = [int(v) for v in rng.integers(-(1 << 63), 1 << 63, 60)]
    flip = lambda v, n: int(np.int64(v) ^ np.int64(sum(1 << int(b) for b in rng.choice(63, n, replace=False))))
    f = [(i, 0, 200 * i, 7, v) for i, v in enumerate(kinds)]  # each descriptor is first owned by a page of its own
    for i in range(60, 160):
        mine, dy = rng.choice(30 if i < 130 else 60, 6, replace=False), int(rng.integers(0, 40))
        f += [(i, 0, 20 * int(k) + dy, 9, flip(kinds[k], int(rng.integers(0, 3)))) for k in mine]
    f += [(i, 0, 20 * k + i, 9, flip(kinds[k], i - 200)) for i in (200, 201) for k in range(40, 50)]
    places = {}
    for i, _, y, x, v in f:
        places.setdefault(i, []).append((y, x, v))

    def linked(a, b):
        votes = {}
        for y, x, v in places[a]:
            for y2, x2, w in places[b]:
                if bin((v ^ w) & (1 << 64) - 1).count("1") <= M.DISTANCE:
                    for h in (0, 0.5):
                        for k in (0, 0.5):
                            votes.setdefault((h, k, np.floor((y2 - y) / M.BIN + h), np.floor((x2 - x) / M.BIN + k)), set()).add((y, x))
        return any(len(s) >= M.CONSENSUS for s in votes.values())

    want = {i: i for i in places}
    for a in places:
        for b in places:
            if a != b and want[a] != want[b] and linked(a, b):
                lo, hi = sorted((want[a], want[b]))
                want = {i: lo if c == hi else c for i, c in want.items()}
    monkeypatch.setattr(M, "describe", lambda images: spark.createDataFrame(f, "id long, scale int, y int, x int, bits long"))
    images = spark.createDataFrame([(i, 9, bytearray(str(i).encode())) for i in places], "id long, width int, pixels binary")
    got = {r["id"]: r["copy_of"] for r in M.copies(images).collect()}
    assert got == want and got[201] == 200 and 20 < len(set(want.values())) < len(want)


def test_equal_rasters_without_features_are_copies(spark):
    rng = np.random.default_rng(9)
    small = [bytearray(rng.integers(0, 256, 70, dtype=np.uint8).tobytes()) for _ in range(3)]
    flat, big = bytearray(40 * 40), picture(rng)
    rows = [(1, 10, small[0]), (2, 10, small[1]), (3, 10, small[0]), (4, 7, small[0]), (5, 10, small[2]), (6, 10, small[2]), (5, 10, small[0]), (7, 40, flat), (8, 40, flat), (9, 10, bytearray()), (10, 10, bytearray()), (None, 10, small[1])]
    rows += [(i, 140, bytearray(big.tobytes())) for i in (20, 21, 22)] + [(23, 130, bytearray(big[:, 10:].tobytes()))]
    got = {r["id"]: (r["copy_of"], r["n_features"]) for r in M.copies(spark.createDataFrame(rows, "id long, width int, pixels binary")).collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 1, 6: 1, 7: 7, 8: 7, 9: 9, 10: 10, 20: 20, 21: 20, 22: 20, 23: 20}
    assert got[7][1] == got[1][1] == 0 and got[20][1] == got[22][1] > 20


def plain_features(image):
    """Corners and descriptors of one image, pixel window by pixel window."""
    def box(a):
        p = np.pad(a, 1, mode="edge")
        rows = p[:-2] + p[1:-1] + p[2:]
        return (rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]) / 9

    out, a = [], image.astype(float)
    for scale in range(M.SCALES):
        h, w = a.shape
        if min(h, w) < 2 * M.RADIUS + 3:
            break
        s = box(a)
        gy, gx = np.gradient(s)
        xx, yy, xy = box(gx * gx), box(gy * gy), box(gx * gy)
        r = np.round(xx * yy - xy * xy - 0.05 * (xx + yy) ** 2, 6)
        m, c, d = M.RADIUS + 1, M.CELL // 2, M.RADIUS
        for y in range(m, h - m):
            for x in range(m, w - m):
                if r[y, x] > 0 and r[y, x] >= r[y - c : y + c + 1, x - c : x + c + 1].max():
                    patch = s[y - d : y + d + 1, x - d : x + d + 1] * M._DISC
                    turn = int(np.rint(np.arctan2((patch * M._Y).sum(), (patch * M._X).sum()) / (2 * np.pi) * M.TURNS)) % M.TURNS
                    t = M.TESTS[turn]
                    out.append((scale, y, x, int(np.packbits(s[y + t[:, 0], x + t[:, 1]] < s[y + t[:, 2], x + t[:, 3]]).view(">i8")[0])))
        a = a[: h // 2 * 2, : w // 2 * 2].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))
    return out


def test_images_worked_on_together_have_the_features_of_each_alone(monkeypatch):
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, (int(rng.integers(1, 90)), w), dtype=np.uint8) for w in (9, 15, 31, 64) for _ in range(12)] + [np.full((40, 40), 7, np.uint8)]
    want = sorted((k, *f) for k, a in enumerate(images) for f in plain_features(a))
    for pixels in (1, 20_000, M.PIXELS):
        monkeypatch.setattr(M, "PIXELS", pixels)
        assert sorted(zip(*(c.tolist() for c in M.all_features(images)))) == want
    assert len(want) > 100 and sorted(M.features(images[40])) == [w[1:] for w in want if w[0] == 40]


def test_no_shuffle_of_a_staged_table_stays(spark, monkeypatch):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum("shuffle_" in str(f) for f in files.getAllFiles().mkString(" ").split(" "))
    left, stage = [], M.stage

    def counted(df):
        before, out = shuffles(), stage(df)
        left.append(shuffles() - before)
        return out

    monkeypatch.setattr(M, "stage", counted)
    rng = np.random.default_rng(6)
    rows = [(i, 140, bytearray(picture(rng).tobytes())) for i in range(6)]
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert M.copies(spark.createDataFrame(rows, "id long, width int, pixels binary")).count() == 6
    assert len(left) > 8 and max(left) <= 0 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_full_entries_are_parted_and_not_paired(spark, monkeypatch):
    """2,000 descriptors that agree in 26 bits (one entry of two whole parts), against brute force."""
    rng = np.random.default_rng(12)
    v = np.unique(rng.integers(0, 1 << 38, 2000).astype(np.uint64) << np.uint64(26))
    v = np.unique(np.r_[v, v[:300] ^ np.uint64(1 << 63), v[100:200] ^ np.uint64(0b111 << 30), v[:50] ^ np.uint64(1)])
    i, j = np.triu_indices(len(v), 1)
    close = np.bitwise_count(v[i] ^ v[j]) <= M.DISTANCE
    want = {tuple(sorted(p)) for p in zip(v[i[close]].view(np.int64).tolist(), v[j[close]].view(np.int64).tolist())}
    bits = spark.createDataFrame([(b,) for b in v.view(np.int64).tolist()], "bits long")
    got = [(a, b) for a, b in M.near_descriptors(bits).collect() if a < b]
    assert sorted(got) == sorted(want) and len(want) > 400
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(M.np, "bitwise_count", lambda x: compared.append(len(x)) or count(x))
    for k in range(4):
        M._within(v, [b for b in range(64) if b // 16 != k])
    assert sum(compared) < 0.05 * len(i)


def linked(a, b):
    """Of two images' (y, x, descriptor): has one shift CONSENSUS of a's places?"""
    votes = {}
    for y, x, v in a:
        for y2, x2, w in b:
            if bin((v ^ w) & (1 << 64) - 1).count("1") <= M.DISTANCE:
                for h in (0, 0.5):
                    for k in (0, 0.5):
                        votes.setdefault((h, k, np.floor((y2 - y) / M.BIN + h), np.floor((x2 - x) / M.BIN + k)), set()).add((y, x))
    return any(len(s) >= M.CONSENSUS for s in votes.values())


def test_what_repeats_meets_as_lists(spark, monkeypatch):
    """Images full of one pattern (few link), near copies whose groups meet in images that are not their fullest, against brute force."""
    rng = np.random.default_rng(15)
    kinds = [int(v) for v in rng.integers(-(1 << 63), 1 << 63, 60)]
    near = lambda v: int(np.int64(v) ^ np.int64(0b101))
    f = [(i, 0, int(y), int(x), kinds[0]) for i in range(6) for y, x in zip(rng.integers(0, 20_000, 40), rng.integers(0, 500, 40))]
    f += [(i, 0, y + 8, x, v) for i, y, x, v in [(6, *r[2:]) for r in f if r[0] == 3][:9]]  # a part of image 3
    for i, base in ((20, 1), (21, 1), (22, 1), (30, 11), (31, 11), (32, 11)):
        f += [(i, 0, 900 * k, 9, kinds[base + k]) for k in range(5)]
    for i, own, some in ((20, range(21, 31), False), (30, range(21, 31), True), (22, range(31, 35), False), (32, range(31, 35), True)):
        # the fullest of both groups share descriptors at no shift, one other of each shares four at one
        f += [(i, 0, int(rng.integers(0, 20_000)) if i in (20, 30) else 700 * k + i, 40, near(kinds[k]) if some else kinds[k]) for k in own]
    places = {}
    for i, _, y, x, v in f:
        places.setdefault(i, []).append((y, x, v))
    want = {i: i for i in places}
    for a in places:
        for b in places:
            if want[a] != want[b] and (linked(places[a], places[b]) or linked(places[b], places[a])):
                lo, hi = sorted((want[a], want[b]))
                want = {i: lo if c == hi else c for i, c in want.items()}
    rows, voted = [], M.voted

    def counted(met, consensus):
        rows.append(met.count())
        return voted(met, consensus)

    monkeypatch.setattr(M, "voted", counted)
    monkeypatch.setattr(M, "describe", lambda images: spark.createDataFrame(f, "id long, scale int, y int, x int, bits long"))
    images = spark.createDataFrame([(i, 9, bytearray(str(i).encode())) for i in places], "id long, width int, pixels binary")
    got = {r["id"]: r["copy_of"] for r in M.copies(images).collect()}
    assert got == want and want[6] == 3 and want[32] == 20 and len(set(want.values())) > 4
    assert sum(rows) < 1_000, rows  # places by places: over 40,000
