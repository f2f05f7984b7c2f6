"""SimHash, substring dedup and embedding near-dedup against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fathomline.llm import embedding_dedup, near_copies, simhash, substring_dedup
from fathomline.operators.graph import connected_components

SCHEMA = "doc_id long, text string, source string, fingerprint string, id long"


def docs(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "s", "x", 5) for i, t in rows], SCHEMA)


def words(rnd, n, tag="w"):
    return [f"{tag}{rnd.randrange(4000)}" for _ in range(n)]


def plain_fingerprint(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def joined(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks, rnd = simhash.covering_masks(radius), random.Random(radius)
    for _ in range(3000):
        flips = sum(1 << b for b in rnd.sample(range(64), radius))
        assert any(not flips & m for m in masks)


def test_fingerprints_and_components(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        w = words(rnd, rnd.choice([1, 2, 3, 5, 40, 300]))
        rows.append((i, " ".join(w)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join([*w[:-1], "Changed"])))
            rows.append((2000 + i, " ".join(w).upper()))
    rows += [(5000, ""), (5001, None), (5002, " \n\t"), (5003, "É ç\x0b中文 \x1c"), (5004, "A" * 200_000), (3, dict(rows)[3]), (None, "lonely words here now")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = {i: plain_fingerprint(t) for i, t in rows}
    assert {(r["id"], int(r["fingerprint"], 16)) for r in got} == set(fp.items())
    known = [i for i in fp if i is not None]
    want = joined([(a, b) for a in known for b in known if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], known)
    assert {r["id"]: r["component_id"] for r in got if r["id"] is not None} == want


def test_rows_of_one_id_are_dropped_one_by_one(spark):
    """A unique text stays though another row of its id is a copy; one row of each component is left."""
    x, y, z = (" ".join(words(random.Random(k), 50)) for k in range(3))
    rows = [(3, x), (5, y), (5, x), (5, y), (6, y), (5, z), (5, None), (2, None)]
    kept = sorted((r["doc_id"], r["text"] or "") for r in simhash.drop_near_duplicates(docs(spark, rows)).collect())
    assert kept == sorted([(3, x), (5, y), (5, z), (2, "")])
    # near copies, too: one word of 50 more
    rows = [(3, x), (5, y), (5, x + " more"), (7, y + " more")]
    import corpus_pipeline

    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect())
    assert kept == sorted([(3, x), (5, y)])


def test_near_links_are_all_true_and_enough(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(30)]
    bits = {b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(5))) for b in base for _ in range(12)} | {0, (1 << 64) - 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in bits]
    for radius, bucket in ((1, 2048), (2, 2048), (2, 2), (3, 4), (4, 64)):
        got = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(x,) for x in signed], "bits long"), radius, bucket).collect()]
        assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius for a, b in got)
        near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius]
        assert joined(got, signed) == joined(near, signed)


def test_near_links_of_a_dense_bucket(spark):
    """5,000 fingerprints that agree in 51 bits: one bucket of the masks that close few others."""
    rnd = random.Random(8)
    base, places = rnd.getrandbits(64), rnd.sample(range(64), 16)
    bits = {base ^ sum(1 << p for k, p in enumerate(places) if x >> k & 1) for x in rnd.sample(range(1 << 16), 5000)}
    signed = [x - (1 << 64) if x >> 63 else x for x in bits]
    got = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(x,) for x in signed], "bits long"), 2, 512).collect()]
    every, near = np.array(signed, np.int64), []
    for k, x in enumerate(signed):
        near += [(x, int(y)) for y in every[k + 1 :][np.bitwise_count((every[k + 1 :] ^ x).view(np.uint64)) <= 2]]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in got)
    assert joined(got, signed) == joined(near, signed)


def test_drop_near_duplicates(spark):
    text = " ".join(words(random.Random(2), 50))
    rows = [(4, text), (9, text), (4, text), (7, "quite another text of eight words it is"), (None, text), (11, "")]
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 4), (False, 7), (False, 11), (True, 0)]
    assert simhash.drop_near_duplicates(docs(spark, [])).count() == 0


def test_pipeline_stage_drops_near_copies(spark):
    """Copies of 5-word similarity 0.8 or more go, all others that SimHash leaves stay, against brute force."""
    import corpus_pipeline

    rnd, rows, sets = random.Random(29), [], {}
    for i in range(0, 120, 2):
        w = words(rnd, 200)
        c = list(w)
        for k in range(i % 8 + 1):
            c[int((k + 0.5) * 200 / (i % 8 + 1))] = f"x{k}"
        rows += [(i, " ".join(w)), (i + 1, " ".join(c))]
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(196)}
    near = {i + 1 for i in range(0, 120, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    assert 0 < len(near) < 60
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()}
    assert near & kept
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()}
    assert got == kept - near
    print(len(near), len(near & kept))


def test_settings_of_the_session_stay(spark):
    before = dict(spark.conf.getAll)
    simhash.drop_near_duplicates(docs(spark, [(1, "a b c"), (2, "a b c")])).collect()
    after = {k: v for k, v in spark.conf.getAll.items() if before.get(k) != v}
    assert after in ({}, {"spark.sql.execution.arrow.maxBytesPerBatch": spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")}) and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b"


def test_components_of_a_long_chain(spark):
    edges = spark.range(500).select((F.col("id") * 3 % 500).alias("a"), ((F.col("id") * 3 + 3) % 500).alias("b"))
    got = connected_components(edges, "a", "b")
    assert got.count() == 500 and {r["component"] for r in got.collect()} == {0}
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def passage_rows():
    rnd = random.Random(3)
    shared, fuzzy = words(rnd, 70, "s"), words(rnd, 120, "f")
    changed = [("x" + w if k % 15 == 7 else w) for k, w in enumerate(fuzzy)]
    a = [*words(rnd, 100), *shared, *words(rnd, 60)]
    b = [*words(rnd, 30), *shared, *words(rnd, 90), *fuzzy]
    c = [*words(rnd, 20), *changed, *words(rnd, 80)]
    d = [*words(rnd, 10), *shared[:30], *words(rnd, 80)]
    return [(1, " ".join(a)), (2, "\n ".join(b)), (3, " ".join(c)), (4, " ".join(d)), (5, " ".join(a)), (6, "short"), (7, ""), (8, None), (None, " ".join(a))], shared, fuzzy


def test_passages(spark):
    rows, shared, fuzzy = passage_rows()
    got = substring_dedup.shared_passages(docs(spark, rows)).collect()
    text = dict(rows)
    by = {(r["id"], r["other"]): r for r in got}
    assert set(by) == {(2, 1), (3, 2), (5, 1)}
    r = by[2, 1]
    assert text[2][r["start"] : r["end"]].split() == shared and text[1][r["other_start"] : r["other_end"]].split() == shared and r["similarity"] == 1.0
    r = by[3, 2]
    assert r["n_words"] == 120 and 0.9 < r["similarity"] < 0.95 and text[2][r["other_start"] : r["other_end"]].split() == fuzzy
    assert by[5, 1]["exact_copy"] and by[5, 1]["n_words"] == 230


def test_cut_passages(spark):
    rows, shared, _ = passage_rows()
    df = docs(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    got = substring_dedup.cut_shared_passages(df)
    assert got.columns == df.columns
    text = {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"] is not None}
    assert set(text) == {1, 2, 3, 4, 6, 7, 8}
    assert text[1] == dict(rows)[1] and not set(shared) & set(text[2].split()) and len(text[3].split()) == 100 and text[4] == dict(rows)[4]
    assert {r["doc_id"]: r["n_chars"] for r in got.collect() if r["doc_id"]}[2] == len(text[2])
    assert substring_dedup.cut_shared_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(60, 80, 60), (60, 120, 60), (100, 150, 100), (300, 500, 300)])
def test_passages_with_other_text_between(spark, sizes):
    """Both passages of a pair are found, and the text between them stays, as brute force over words says."""
    rnd, rows, want = random.Random(sum(sizes)), [], {}
    for i in range(0, 24, 2):
        one, two = words(rnd, sizes[0], f"o{i}_"), words(rnd, sizes[2], f"t{i}_")
        for k in (i, i + 1):
            own = [words(rnd, n, f"w{k}_") for n in (20, sizes[1], 30)]
            rows.append((k, " ".join([*own[0], *one, *own[1], *two, *own[2]])))
            want[k] = set(one + two)
    got = {k: set() for k in want}
    for r in substring_dedup.shared_passages(docs(spark, rows)).collect():
        got[r["id"]] |= set(dict(rows)[r["id"]][r["start"] : r["end"]].split())
    assert got == {k: (w if k % 2 else set()) for k, w in want.items()}


def test_passage_whose_parts_have_lesser_holders(spark):
    """Its halves stand in others with lesser ids, at two places each: the pair that shares it whole is found."""
    rnd, rows, want = random.Random(17), [], set()
    for i in range(0, 80, 4):
        p = words(rnd, 60, f"p{i}_")
        for k, own in enumerate((p[:30], p[30:])):
            rows.append((i + k, " ".join([*words(rnd, 40), *own, *words(rnd, 50), *own, *words(rnd, 20)])))
        for k in (2, 3):
            rows.append((i + k, " ".join([*words(rnd, 25), *p, *words(rnd, 35)])))
        want.add((i + 3, " ".join(p)))
    got = substring_dedup.shared_passages(docs(spark, rows)).collect()
    assert {(r["id"], dict(rows)[r["id"]][r["start"] : r["end"]]) for r in got} == want


def fuzzy_rows(pairs=25):
    """Pairs that share a passage with words replaced at random or evenly, and for each the case and the passage's words in the second."""
    rnd, rows, cases = random.Random(23), [], {}
    for n in (55, 60, 100):
        for alike in (0.8, 0.85, 0.9):
            for even in (False, True):
                for _ in range(pairs):
                    i, p = len(rows), words(rnd, n, f"p{len(rows)}_")
                    lost = int(n * (1 - alike) + 1e-9)
                    at = {int((k + 0.5) * n / lost) for k in range(lost)} if even else set(rnd.sample(range(1, n - 1), lost))
                    q = [f"x{k}_{i}" if k in at else w for k, w in enumerate(p)]
                    rows += [(i, " ".join([*words(rnd, 60), *p, *words(rnd, 60)])), (i + 1, " ".join([*words(rnd, 80), *q, *words(rnd, 50)]))]
                    cases[i + 1] = ((n, alike, even), {w for w in q if w[0] == "p"})
    return rows, cases


def test_fuzzy_passages(spark):
    """Recall by words in the passage, similarity, and whether changes are evenly spaced."""
    rows, cases = fuzzy_rows()
    text, found = dict(rows), {}
    for r in substring_dedup.shared_passages(docs(spark, rows)).collect():
        assert r["other"] == r["id"] - 1
        found.setdefault(r["id"], set()).update(text[r["id"]][r["start"] : r["end"]].split())
    hits = {}
    for i, (case, kept) in cases.items():
        hits.setdefault(case, []).append(len(kept & found.get(i, set())) >= 0.8 * len(kept))
    recall = {c: sum(h) / len(h) for c, h in hits.items()}
    print(recall)
    for (n, alike, _), r in recall.items():
        assert r >= (0.95 if alike >= 0.85 or n >= 100 else 0.8), recall


@pytest.mark.parametrize("seed", range(3))
def test_common_words_of_long_gaps(seed):
    rnd = random.Random(seed)
    a, b = ([str(rnd.randrange(9)) for _ in range(rnd.randrange(110, 150))] for _ in range(2))
    row = [0] * (len(b) + 1)
    for w in a:
        last = [0] * (len(b) + 1)
        for j, v in enumerate(b):
            last[j + 1] = row[j] + 1 if w == v else max(row[j + 1], last[j])
        row = last
    assert substring_dedup._common(a, b) == row[-1]


def test_every_shared_window_is_found(spark):
    rnd = random.Random(11)
    pool = [words(rnd, rnd.randrange(51, 140), f"p{k}_") for k in range(6)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            parts += [*words(rnd, rnd.randrange(5, 60)), *(rnd.choice(pool) if rnd.random() < 0.6 else [])]
        rows.append((i, " ".join(parts)))
    spans: dict[int, list] = {}
    for r in substring_dedup.shared_passages(docs(spark, rows)).collect():
        spans.setdefault(r["id"], []).append((r["start"], r["end"]))
    seen: set = set()
    for i, t in rows:
        at = [m.span() for m in re.finditer(r"\S+", t)]
        mine = [tuple(t.split()[k : k + 51]) for k in range(len(at) - 50)]
        for k, window in enumerate(mine):
            if window in seen:
                assert all(any(a <= x and y <= b for a, b in spans.get(i, [])) for x, y in at[k : k + 51]), (i, k)
        seen |= set(mine)


def spans_of(spark, rows, **how):
    """The text of each passage found, by id."""
    text, out = {}, {}
    for i, t in rows:
        text.setdefault(i, t)
    for r in substring_dedup.shared_passages(docs(spark, rows), **how).collect():
        out.setdefault(r["id"], []).append(text[r["id"]][r["start"] : r["end"]])
    return out


@pytest.mark.parametrize("first", [1, 101])
def test_passage_whose_pieces_stand_in_many_others(spark, first):
    """80 words that two documents share, 14-word pieces of which stand in eight lesser documents, or in eight between them."""
    rnd = random.Random(first)
    p = words(rnd, 80, "p")
    rows = [(100, " ".join([*words(rnd, 40), *p, *words(rnd, 30)])), (200, " ".join([*words(rnd, 20), *p, *words(rnd, 50)]))]
    rows += [(first + k, " ".join([*words(rnd, 60), *p[9 * k : 9 * k + 14], *words(rnd, 60)])) for k in range(8)]
    assert spans_of(spark, rows) == {200: [" ".join(p)]}


def test_passages_of_equal_words_and_of_letters_that_change_length(spark):
    rnd = random.Random(41)
    odd = [f"İ{k}w" if k % 9 == 4 else f"Ab{k}" for k in range(70)]
    same = ["word"] * 60
    rows = [(k, " ".join([*words(rnd, 30, "u"), *odd, *words(rnd, 30, "v")])) for k in (1, 2)]
    rows += [(k, " ".join([*words(rnd, 30, "u"), *same, *words(rnd, 30, "v")])) for k in (3, 4)]
    assert spans_of(spark, rows) == {2: [" ".join(odd)], 4: [" ".join(same)]}


def test_different_texts_of_one_id(spark):
    """Each is a document of its own; equal ones count as one, and each is cut by its own passages."""
    rnd = random.Random(43)
    p, q = words(rnd, 60, "p"), words(rnd, 60, "q")
    alone = " ".join(words(rnd, 90))
    rows = [(1, " ".join(p + words(rnd, 30))), (2, " ".join(q + words(rnd, 30)))]
    rows += [(7, " ".join(["a1", *p, "a2"])), (7, " ".join(["b1", *q, "b2"])), (7, alone), (7, alone), (8, alone)]
    df = docs(spark, rows)
    got = sorted((r["doc_id"], r["text"]) for r in substring_dedup.cut_shared_passages(df, length_col=None).collect())
    assert got == sorted([*rows[:2], (7, "a1  a2"), (7, "b1  b2"), (7, alone), (7, alone)])


def test_hot_seeds_and_reach_change_nothing(spark):
    """Ranges of ids for hot seeds, and few words read at first, give the same passages."""
    rnd = random.Random(47)
    p = words(rnd, 400, "p")
    rows = [(k, " ".join([*words(rnd, 30), *p[k % 3 * 60 : 220 + k % 7 * 30], *words(rnd, 20)])) for k in range(60)]
    from dataclasses import replace

    def found(**how):
        out = sorted(map(tuple, substring_dedup.shared_passages(docs(spark, rows), rules=replace(substring_dedup.RULES, **how)).collect()))
        return out, {i: {k for r in out if r[0] == i for k in range(r[2], r[3])} for i, _ in rows}

    want, covered = found()
    assert len(want) >= 59
    assert found(hot_docs=1)[0] == want
    few = found(reach=50)[1]  # rows may end where another passage of the document goes on, up to a word that agrees by chance
    assert all(len(few[i] ^ covered[i]) <= 12 for i in covered), {i: sorted(few[i] ^ covered[i]) for i in covered}


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)", "smallint", "date"])
def test_passages_by_ids_of_other_types(spark, kind):
    p = words(random.Random(53), 60)
    df = docs(spark, [(k, " ".join([f"x{k}", *p])) for k in (1, 2)])
    as_id = F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int")) if kind == "date" else F.col("doc_id").cast(kind)
    got = substring_dedup.shared_passages(df.withColumn("doc_id", as_id))
    assert got.schema["id"].dataType.simpleString() == kind and [r["n_words"] for r in got.collect()] == [60]


def test_one_very_long_text(spark):
    """A passage deep in a text of 3 MB, and a word of 2 MB."""
    rnd = random.Random(59)
    p = words(rnd, 80, "p")
    rows = [(1, " ".join([*words(rnd, 300_000), *p, *words(rnd, 200_000)])), (2, " ".join(["z" * 2_000_000, *p])), (3, "z" * 2_000_000)]
    assert spans_of(spark, rows) == {2: [" ".join(p)]}


@pytest.mark.parametrize("seed", range(4))
def test_chains_are_best(seed):
    """The Fenwick tree's scores against the quadratic recurrence."""
    rnd, rules = random.Random(seed), substring_dedup.RULES
    points = sorted({(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)})
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    best = []
    for i in range(len(points)):
        gains = [best[j] - rules.gap * (x[i] + y[i] - x[j] - y[j] - 2 * rules.k) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
        best.append(rules.k + max([0.0, *gains]))
    paths = substring_dedup.chains(x, y)
    assert len({i for p in paths for i in p}) == sum(map(len, paths))
    for p in paths:
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(p, p[1:], strict=False))
    if paths:
        p = paths[0]
        score = rules.k * len(p) - sum(rules.gap * (x[b] - x[a] + y[b] - y[a] - 2 * rules.k) for a, b in zip(p, p[1:], strict=False))
        assert score == pytest.approx(max(best))


def vector_rows():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24))
    rows = []
    for i in range(400):
        v = centres[i % 40] + rng.standard_normal(24) * rng.choice([0.05, 0.15, 0.3, 1.0])
        rows.append((i, [float(np.float32(c)) for c in v]))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 2)]
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0, None] * 12), (2004, [1.0, 2.0]), (2005, [2.0, 4.0]), (2006, [])]
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_embeddings(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, head long")
    got = {r["id"]: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(good)
    links = {i: [j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.95] for i in ids}
    total, found = sum(map(len, links.values())), sum(r["n_links"] for r in got.values())
    assert len(got) == len(rows) and all(got[i]["n_links"] <= len(links[i]) for i in ids)
    assert found >= 0.97 * total > 0
    for i in (2000, 2001, 2002, 2003, 2006):
        assert tuple(got[i]) == (i, 0, i, True)
    assert got[2005]["component_id"] == 2004 and not got[2005]["kept"]
    for i in range(0, 60, 2):  # equal vectors are always linked
        assert got[1000 + i]["component_id"] == got[i]["component_id"]


def test_two_vectors_of_one_id_and_null_ids(spark):
    v, w = [1.0, 0.0, 0.1], [0.0, 1.0, 0.3]
    near = lambda x: [c * 2 + 0.001 for c in x]
    rows = [(5, v), (5, w), (5, w), (7, near(v)), (8, near(w)), (None, v), (9, [1.0, 1.0, 1.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, x, "m", "c") for i, x in rows], f"vec_id long, embedding array<{kind}>, mark string, code string")
        got = sorted((r["id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect())
        assert got == [(-1, 0, None, True), (5, 1, 5, True), (5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (8, 1, 5, False), (9, 0, 9, True)]


def test_block_size_changes_nothing(spark):
    df = spark.createDataFrame([(i, v) for i, v in vector_rows()], "vec_id long, embedding array<float>")
    rows = lambda b: sorted(map(tuple, embedding_dedup.near_duplicates(df, block=b).collect()))
    assert rows(1024) == rows(16)
    assert tuple(map(len, map(set, [rows(1024)]))) == (len(vector_rows()),)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def _scrambled_families(kind: str, n: int, words: int = 80, alike: float = 0.9, piece: int = 12) -> tuple[list, list]:
    """Documents whose passage's phrases also stand in another order, in six other documents or earlier in the holder; and where each fuzzy copy lies."""
    rng, rows, wanted = random.Random(5), [], []
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    filler = lambda k: [word() for _ in range(k)]
    add = lambda w: rows.append((len(rows), " ".join(w)))
    for _ in range(n):
        p = filler(words)
        pieces = [p[i : i + piece] for i in range(0, words, piece)]
        scrap = lambda: [w for q in rng.sample(pieces, len(pieces)) for w in q + filler(3)]  # noqa: B023, E731
        copy = list(p)
        for i in rng.sample(range(words), round(words * (1 - alike))):
            copy[i] = word()
        if kind == "others":
            for holder in (None, None, None, p, None, None, None):
                add(filler(30) + (holder or scrap()) + filler(30))
        else:
            add(filler(10) + scrap() + filler(30) + p + filler(30))
        head = filler(25)
        start = len(" ".join(head)) + 1
        wanted.append((len(rows), start, start + len(" ".join(copy))))
        add(head + copy + filler(25))
    return rows, wanted


@pytest.mark.parametrize(("kind", "least"), [("others", 0.5), ("earlier", 0.9)])
def test_fuzzy_passages_are_found_where_their_phrases_stand_elsewhere_too(spark, kind, least):
    """README has the recall of both; many other holders still hide passages."""
    rows, wanted = _scrambled_families(kind, 60)
    found = substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    longest = {d: max((min(r["end"], z) - max(r["start"], a) for r in found if r["id"] == d), default=0) / (z - a) for d, a, z in wanted}
    assert sum(share >= 0.6 for share in longest.values()) >= least * len(wanted)


def test_places_of_a_seed_beyond_the_bound_are_matched_by_number(spark):
    """A text that says one phrase a hundred times doesn't hide a passage behind it, and gives no hundred times hundred matches."""
    rng = random.Random(3)
    filler = lambda k: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(k)]
    p, phrase = filler(60), filler(4)
    said = lambda: [w for _ in range(100) for w in phrase + filler(2)]
    texts = [" ".join(said() + p + filler(5)), " ".join(filler(5) + p + said())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = substring_dedup.shared_passages(docs).collect()
    at = texts[1].index(" ".join(p))
    assert any(r["id"] == 1 and r["start"] <= at and r["end"] >= at + len(" ".join(p)) for r in found)
    ids = docs.select(docs["doc_id"].alias("id"))
    rows = docs.selectExpr("doc_id as id", "0 as copy", "text")
    assert substring_dedup._matches(rows, ids, substring_dedup.RULES).count() < 2000


def test_exact_passage_whose_seeds_have_many_other_holders(spark):
    """50 words that two documents share, while all windows of 40 of their words stand in lesser documents and in those between."""
    rnd = random.Random(61)
    p = words(rnd, 50, "p")
    rows = [(100, " ".join([*words(rnd, 40), *p, *words(rnd, 30)])), (200, " ".join([*words(rnd, 20), *p, *words(rnd, 50)]))]
    rows += [(i + k, " ".join([*words(rnd, 60), *p[k : k + 40], *words(rnd, 60)])) for k in range(11) for i in (1, 101)]
    assert spans_of(spark, rows) == {200: [" ".join(p)]}


def test_exact_passages_among_repeated_words_and_lines(spark):
    """Every word of a window of 50 words that a lesser document holds is covered, whatever else repeats: runs of one word, lines, few words."""
    rnd = random.Random(59)
    lines = [words(rnd, 12, f"l{k}_") for k in range(4)]
    rows = [(0, " ".join([*words(rnd, 30), *["a"] * 50, *words(rnd, 30)])), (1, " ".join([*words(rnd, 9), *["a"] * 400, *words(rnd, 9)]))]
    for i in range(2, 40):
        parts = []
        for _ in range(12):
            parts += rnd.choice(lines)[: rnd.choice([12, 12, 12, 7])] * rnd.choice([1, 1, 5])
        rows.append((i, " ".join([*words(rnd, 5), *parts, *["a"] * rnd.randrange(40), *parts[:33], *words(rnd, 5)])))
    spans, seen = {}, set()
    for r in substring_dedup.shared_passages(docs(spark, rows)).collect():
        spans.setdefault(r["id"], []).append((r["start"], r["end"]))
    for i, t in rows:
        at, w = [m.span() for m in re.finditer(r"\S+", t)], t.split()
        mine = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        want = {j for k, window in enumerate(mine) if window in seen for j in range(k, k + 50)}
        assert all(any(a <= at[j][0] and at[j][1] <= b for a, b in spans.get(i, [])) for j in want), i
        seen |= set(mine)


def test_covering_matches():
    x = np.array([0, 1, 2, 3, 4, 60, 61, 5, 6, 7], np.int32)
    y = np.array([9, 10, 3, 3, 3, 40, 41, 8, 9, 10], np.int32)
    assert substring_dedup.covering(x, y, np.array([0, 7, 10]), 50).tolist() == [0, 4, 5, 7]


def test_near_copies_that_the_ends_of_a_bucket_leave_apart(spark, monkeypatch):
    """All texts in one bucket, of which the least and the greatest are unlike the rest: the groups are those of all pairs."""
    monkeypatch.setattr(near_copies, "bands", lambda hashes: [1])
    rnd = random.Random(67)
    one, two = words(rnd, 100, "p"), words(rnd, 100, "q")
    rows = [(0, " ".join(words(rnd, 100, "a"))), (99, " ".join(words(rnd, 100, "z")))]
    for k in range(1, 7):  # a chain: each is like the next alone
        rows.append((k, " ".join([*words(rnd, 7 * k, f"n{k}_"), *one[7 * k :]])))
    rows += [(20 + k, " ".join([*two[:99], f"t{k}"])) for k in range(3)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert near
    pairs = [(r["id"], r["other"]) for r in near_copies.near_pairs(docs(spark, rows)).collect()]
    assert {tuple(sorted(p)) for p in pairs} <= set(near) and joined(pairs, list(sets)) == joined(near, list(sets))


def test_runs_of_one_word_give_few_rows_and_all_words(spark):
    """Of 900 equal words and a lesser document's 60: a row for some shifts covers all of them, not one for each."""
    rnd = random.Random(71)
    rows = [(k, " ".join([*words(rnd, 30, f"u{k}_"), *["a"] * n, *words(rnd, 30, f"v{k}_")])) for k, n in enumerate((60, 900))]
    rows += [(k, " ".join([*words(rnd, 30, f"u{k}_"), *["b", "c", "d"] * n, *words(rnd, 30, f"v{k}_")])) for k, n in ((2, 25), (3, 200))]
    found = substring_dedup.shared_passages(docs(spark, rows)).collect()
    assert {(r["id"], r["other"]) for r in found} == {(1, 0), (3, 2)}
    for i in (1, 3):
        run = [m.span() for m in re.finditer(r"\S+", rows[i][1])][30:-30]
        mine = [(r["start"], r["end"]) for r in found if r["id"] == i]
        assert all(any(s <= a and b <= e for s, e in mine) for a, b in run) and len(mine) <= 80, len(mine)


def test_chains_of_a_pair_read_its_pieces_once(spark, monkeypatch):
    """90 chains of two texts of 8 pieces are aligned in 16 pieces, not in some for each chain; each in its own pieces, as far as those agree."""
    text = " ".join(words(random.Random(73), 1000))
    texts = spark.createDataFrame([(i, 0, text) for i in (1, 2)], "id long, copy int, text string")
    chains = spark.createDataFrame([(2, 0, 1, 0, [10 * k], [10 * k]) for k in range(90)], "id long, copy int, other long, other_copy int, xs array<int>, ys array<int>")
    read, plain = [], type(chains).mapInArrow
    monkeypatch.setattr(type(chains), "mapInArrow", lambda df, *how: (read.append(df), plain(df, *how))[1])
    rows = substring_dedup._aligned(chains, texts, 128, substring_dedup.RULES).where("start is not null").collect()
    assert read[-1].agg(F.sum(F.size("parts"))).first()[0] == 16
    own = [(max(x - 128, 0) // 128, min(8, (x + 131) // 128 + 1)) for x in range(0, 900, 10)]
    assert sorted(r["n_words"] for r in rows) == sorted(min(1000, 128 * hi) - 128 * lo for lo, hi in own)


def test_few_stretches_are_chained_as_many_are():
    rnd = np.random.default_rng(79)
    for _ in range(1000):
        n = int(rnd.integers(2, 17))
        x, y, length = np.sort(rnd.integers(0, 60, n)), rnd.integers(0, 60, n), rnd.integers(1, 4, n)
        first = np.cumsum(np.append(0, length[:-1]))
        x, y = (np.concatenate([np.arange(a, a + m) for a, m in zip(c, length, strict=True)]) for c in (x, y))
        how = first, first + length - 1, x, y, substring_dedup.RULES
        assert substring_dedup._joined(*how) == substring_dedup._joined(*how, few=0)
