"""BPE, quality rules, chat formatting, WARC and mixing against brute force, round trips and edge cases."""

import base64
import hashlib
import math
import random
import re
from fractions import Fraction
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from fathomline.llm import bpe, chat, mixing, quality_rules, warc

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "b", "Th", " ", "  ", "\n", "'", "'s", "'ll", "1", "23", "é", "中文", " ", " ", "!", "...", "\t", "\r\n", "\x1c", "\x85", "🙂", "the ", " of"]


@pytest.mark.parametrize(("leaf", "window"), [(8, 1), (16, 2), (64, 32)])
def test_tree_equals_one_pass(leaf, window):
    codec, rnd = bpe.Codec(RANKS, P.PATTERN, leaf, window), random.Random(leaf)
    for _ in range(1500):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(150)))
        ids = codec.encode(text)
        assert ids == codec.short.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_long_runs():
    codec = bpe.Codec(RANKS, P.PATTERN)
    for text in ("a" * 120_000, " " * 50_000 + "x", "ab" * 30_000 + " tail", "\n" * 25_000):
        assert codec.decode(codec.encode(text)) == text.encode()
    piece = b"abcthethe" * 60
    assert bpe.merge(piece, codec.ranks) == codec.short.encode_ordinary(piece.decode())


def test_encode_documents(spark):
    rows = [(1, "Hello  world's"), (2, None), (3, ""), (1, "Hello  world's"), (None, "x y"), (4, "word " * 60_000)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, ids long")
    codec = bpe.Codec(RANKS, P.PATTERN)
    ids = bpe.encode_documents(df, RANKS, P.PATTERN)
    got = [(r["id"], r["ids"]) for r in ids.collect()]
    assert sorted(got, key=str) == sorted(((i, codec.short.encode_ordinary(t or "")) for i, t in rows), key=str)
    back = bpe.decode_documents(ids, RANKS, P.PATTERN)
    assert sorted(map(str, ((r["id"], r["text"]) for r in back.collect()))) == sorted(str((i, t or "")) for i, t in rows)
    made = {r["id"]: r for r in bpe.encode_documents(df, RANKS, P.PATTERN, digests=True).collect()}
    assert made[2]["n_tokens"] == 0 and made[1]["decoded_sha256"] == hashlib.sha256(rows[0][1].encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), RANKS, P.PATTERN).count() == 0


def brute_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics():
    rnd = random.Random(4)
    for _ in range(400):
        text = "".join(rnd.choice(["a", "b", "c ", " ", "\n", "x#|", "\x1c", "\x0b", "é "]) for _ in range(rnd.randrange(120)))
        assert quality_rules.text_stats(text) == brute_stats(text), repr(text)


def test_quality_rules(spark):
    rnd = random.Random(6)
    prose = " ".join("".join(rnd.choice("aeinorstlu") for _ in range(rnd.randrange(2, 9))) for _ in range(400))
    noise = base64.b64encode(rnd.randbytes(3000)).decode()
    rows = [(1, prose), (2, "spam eggs " * 500), (3, " ".join(noise[i : i + 60] for i in range(0, 4000, 60))), (4, ""), (5, None), (6, "one two"), (1, prose), (None, prose), (7, prose * 40)]
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean")
    got = {r["id"]: r for r in quality_rules.quality_report(df).collect()}
    assert got[1]["kept"] and not got[1]["base_failed"]
    assert got[2]["base_failed"] and got[4]["base_failed"] and got[5]["n_words"] == 0 and got[6]["base_failed"]
    assert not got[3]["base_failed"] and not got[3]["kept"] and not got[7]["kept"]
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "None"]
    assert quality_rules.quality_report(df.limit(0)).count() == 0 and quality_rules.keep_good(df.limit(0)).count() == 0


def test_quality_verdict_by_brute_force(spark):
    """The limits from quartiles of the corpus itself, one text after another."""
    import zstandard

    rnd = random.Random(12)
    prose = lambda n: " ".join("".join(rnd.choice("aeinorstlu") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    rows = [(i, prose(rnd.choice([15, 60, 200, 1200]))) for i in range(400)]
    rows += [(1000 + i, " ".join(rnd.choice(["ba", "bo"]) + rnd.choice("xyz") * 3 + rnd.choice("qwertz") for _ in range(300))) for i in range(20)]
    rows += [(2000, rows[0][1]), (2001, None), (2002, "é" * 40 + " ünö" * 30)]
    bands, pack = quality_rules.BANDS, zstandard.ZstdCompressor(level=3).compress
    got = {r["id"]: r for r in quality_rules.quality_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, chunks, sizes = set(), set(), {}
    for i, t in rows:
        if got[i]["base_failed"]:
            continue
        n, script, ratio, parts = sizes[i] = quality_rules.measures((t or "").encode(), pack)
        seen.add((script, int(2 * math.log2(n + 1)), n, ratio))
        chunks |= {(script, m, n) for m in parts}

    def limits(counts):
        out = {}
        for c in {c for c, _ in counts}:
            taken = []
            for k in sorted({k for k, _ in counts}, key=lambda k: (abs(k - c), k)):
                if len(taken) >= bands.least:
                    break
                taken += [m for x, m in counts if x == k]
            taken.sort()
            low, mid, high = (next(m for j, m in enumerate(taken, 1) if j >= q * len(taken)) for q in (0.25, 0.5, 0.75))
            out[c] = int(min(low - 2 * (high - low), mid - 40)), int(max(high + 2 * (high - low), mid + 40))
        return out

    texts = [limits([(c, r) for s, c, _, r in seen if s == k]) for k in range(3)]
    parts = limits([(s, m) for s, m, _ in chunks])
    for i, (n, script, ratio, own) in sizes.items():
        low, high = texts[script][int(2 * math.log2(n + 1))]
        fixed = [x[1:] for x in bands.whole if n >= x[0]][-1]
        out = sum(not max(parts[script][0], 250) <= m <= min(parts[script][1], 680) for m in own)
        assert got[i]["n_chunks_outside"] == out and got[i]["n_chunks"] == len(own)
        assert got[i]["kept"] == (max(low, 1000 * fixed[0]) <= ratio <= min(high, 1000 * fixed[1]) and out <= 0.25 * len(own)), (i, n, ratio)
    assert sum(not got[1000 + i]["kept"] for i in range(20)) >= 15 and sum(not got[i]["kept"] for i in range(400)) <= 8


def test_escapes():
    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choice(["<", "|", "\\", ">", "im_end", "<|im_end|>", "<|endoftext|>", "a"]) for _ in range(rnd.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def chat_rows():
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "system", "é\n"), (1, 1, "user", None), (1, 2, "assistant", "\n\n  lead 中文🙂"), (1, 3, "assistant", "again "), (2, 0, "user", said), (2, 1, "assistant", said)]
    rows += [(3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, None, "user", "first"), (3, 5, "assistant", "a"), (None, 0, "assistant", "no conversation"), (4, 0, None, "x"), (4, 1, "assistant", "")]
    rnd = random.Random(8)
    return rows + [(5, k, rnd.choice(["user", "assistant"]), "word <|x|> \\" * rnd.randrange(6)) for k in range(900)]


@pytest.mark.parametrize("part", [200_000, 50])
def test_chat(spark, part):
    rows = chat_rows()
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, conv string").repartition(3)
    path = P.path("byte_bpe_50k.json")
    got = {r["conv"]: r for r in chat.read_back(chat.format_conversations(df, path, part_chars=part), path).collect()}
    by = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        r, loss = got[c], "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(chat.render(turns)[0])
    assert chat.read_back(chat.format_conversations(df.limit(0), path), path).count() == 0


def test_parts_have_the_tokens_of_the_whole(spark):
    rows = [r for r in chat_rows() if r[0] == 5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = P.path("byte_bpe_50k.json")
    ids = lambda n: [x for r in chat.format_conversations(df, path, part_chars=n).orderBy("task", "part").collect() for x in r["ids"]]
    assert ids(100) == ids(10**9)


def test_one_turn_longer_than_a_part(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "long words " * 900), (1, 2, "user", "x" * 5000), (1, 3, "assistant", "ok"), (2, 0, "assistant", "<|im_end|>" * 300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = P.path("byte_bpe_50k.json")
    found = [sorted(map(tuple, chat.read_back(chat.format_conversations(df, path, part_chars=n), path).collect())) for n in (100, 10**9)]
    assert found[0] == found[1] and found[0][0][1] == 4 and found[0][1][3] == 3000


def page_rows():
    html = ["<p>one</p>", "", None, "<p>one</p>", "é" * 3000, "<p>one</p>", "x" * 200_000] + [f"<html>{k} {'common text ' * 20}</html>" for k in range(200)]
    return [(k * 7 % 1009, f"http://a/{k}\r\nX: y" if k % 5 else None, h) for k, h in enumerate(html)]


@pytest.mark.parametrize("rules", [warc.ARCHIVE, warc.Archive(roll_bytes=30_000, sample_bytes=5_000, dictionary_bytes=2_000)])
def test_warc(spark, tmp_path, rules):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "m") for r in rows], "page_id long, url string, html string, mark string").repartition(3)
    manifest = warc.write_archives(df, str(tmp_path / "w"), rules=rules)
    assert sum(r["records"] for r in manifest.collect()) == len(rows)
    got = {int(r["page_id"]): r for r in warc.read_archives(manifest).collect()}
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", i), i)
    for i, _, h in rows:
        r, data = got[i], (h or "").encode()
        new = top[h or ""] == i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if new else ("revisit", str(top[h or ""])))
        assert r["payload"] == ((h or "") if new else None)
    path = next((tmp_path / "w").glob("*.zst"))
    assert path.read_bytes()[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert warc.read_archives(warc.write_archives(df.limit(0), str(tmp_path / "e"))).count() == 0


def test_warc_repeats_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(5, "u", "same"), (5, "u", "same"), (3, "u", "same"), (None, "u", "same")], "page_id long, url string, html string")
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(df, str(tmp_path / "w"))).collect())
    assert got == {("5", "response", None): 2, ("3", "revisit", "5"): 1, (None, "response", None): 1}


def fluid(weights, blocks):
    """Slots at which each block is due if all sources with blocks left are served at once, by their weights, in exact numbers."""
    left, v, t, out, done = dict(blocks), Fraction(0), Fraction(0), {s: [] for s in blocks}, dict.fromkeys(blocks, 0)
    while left:
        end = min(Fraction(blocks[s]) / weights[s] for s in left)
        for s in left:
            while done[s] < blocks[s] and Fraction(done[s] + 1) / weights[s] <= end:
                done[s] += 1
                out[s].append(t + (Fraction(done[s]) / weights[s] - v) * sum(weights[u] for u in left))
        t, v = t + (end - v) * sum(weights[u] for u in left), end
        left = {s: n for s, n in left.items() if done[s] < n}
    return out


CASES = [
    ({"a": 1, "b": 1}, {"a": 40, "b": 40}),
    ({"a": 99996, "b": 4}, {"a": 3000, "b": 2}),
    ({"a": 5004, "b": 4996}, {"a": 400, "b": 380}),
    ({"a": 7, "b": 2, "c": 1}, {"a": 10, "b": 40, "c": 3}),
    ({f"s{k}": 1 + k * k % 97 for k in range(300)}, {f"s{k}": 1 + k % 5 for k in range(300)}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_pfair_schedule(spark, case):
    """Windows against exact fluid service; each block in its window, each slot once, each source within a block of its share."""
    weights, blocks = CASES[case]
    weights = {s: Fraction(w, sum(weights.values())) for s, w in weights.items()}
    due = fluid(weights, blocks)
    table = spark.createDataFrame([(s, float(weights[s]), n) for s, n in blocks.items()], "source string, weight double, blocks long")
    found = mixing.windows(table)
    want = {(s, j): (math.floor(d[j - 1]) if j else 0, math.ceil(x)) for s, d in due.items() for j, x in enumerate(d)}
    assert {(r["source"], r["block"]): (r["release"], r["deadline"]) for r in found.collect()} == want
    for size in (1 << 16, 4 * len(blocks)):
        rows = mixing.schedule(found, size).collect()
        assert sorted(r["slot"] for r in rows) == list(range(sum(blocks.values())))
        assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
        if size == 1 << 16:  # one range: the schedule of earliest deadlines, slot by slot
            open_, slots = sorted((r, d, s, j) for (s, j), (r, d) in want.items()), {}
            for t in range(len(want)):
                best = min((x for x in open_ if x[0] <= t), key=lambda x: (x[1], x[0], x[2], x[3]))
                open_.remove(best)
                slots[best[2:]] = t
            late = [x for x in slots if slots[x] >= want[x][1]]
            assert not late and all(want[x][0] <= t for x, t in slots.items())


def test_mixing(spark):
    rnd = random.Random(9)
    rows = [(i, "x" * rnd.randrange(50, 150), "big" if i % 3 else f"s{i % 4}") for i in range(1500)] + [(2000, None, None), (2001, "", ""), (3, "x" * 70, "s3"), (None, "y" * 60, "big")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, slot int")
    weights = {"big": 0.5, "s0": 0.3, "s3": 0.2}
    got = mixing.mix(df, weights, block_chars=1000, bucket_rows=200).collect()
    assert len(got) == len(rows)
    slots = defaultdict(set)
    for r in got:
        own = r["source"] if r["source"] in weights else mixing.OTHER
        slots[own].add(r["slot"])
        assert r["release"] <= r["slot"] < r["deadline"]
    assert len(set().union(*slots.values())) == sum(map(len, slots.values()))
    ordered = mixing.mix_documents(df, weights, block_chars=1000, bucket_rows=200)
    assert ordered.columns == df.columns and Counter(map(tuple, ordered.collect())) == Counter(map(tuple, df.collect()))
    first = [r["source"] for r in ordered.take(200)]
    assert {"big", "s0", "s3"} <= set(first)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0
    assert mixing.mix(df).count() == len(rows)


def test_mixing_of_texts_longer_than_a_block(spark):
    """A long text is one block; numbers of blocks and slots have no gaps, and rows of equal length and repeated rows stay."""
    rows = [(i, "x" * (5000 if i % 10 == 0 else 400), f"s{i % 2}") for i in range(60)] + [(1, "x" * 400, "s1")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_chars=1000, bucket_rows=7).collect()
    assert len(got) == len(rows)
    sizes, blocks = {i: len(t) for i, t, _ in rows}, defaultdict(list)
    for r in got:
        blocks[r["source"], r["block"]].append(sizes[r["id"]])
        assert r["release"] <= r["slot"] < r["deadline"]
    for s in ("s0", "s1"):
        assert sorted(b for of, b in blocks if of == s) == list(range(sum(of == s for of, _ in blocks)))
    assert all(len(b) <= 3 or max(b) < 5000 for b in blocks.values()) and all(sum(b) < 1000 + max(b) for b in blocks.values())
    assert {r["slot"] for r in got} == set(range(len(blocks)))
