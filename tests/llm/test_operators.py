"""The training-data operators against plain Python on small tables, edge cases included."""

import hashlib
import itertools
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from retrigauge.llm import attribution, chat, components, fingerprint, language, lines, media, mixing, packing, shared, simhash, tokens, warc
from retrigauge.llm.shared import table, written
from retrigauge.llm.tokens import WordTokenizer, default_path

from ..conftest import DATA

#: Names that the operators use within.
CLASH = ["dropped", "salt", "copies", "below", "times", "size", "h", "fp", "th", "root", "component_id", "least", "low", "node", "key", "taken", "line", "pos", "rk", "_h", "_n", "_s", "_id", "_i", "_t"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and a column whose name clashes."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three", "en", "a", 13), (3, "one two three", "en", "a", 13), (4, long, "en", None, len(long)), (None, "no id here", None, "b", 10), (5, "12 !! 34", "en", "b", 8), (6, "One Two three", "fr", "b", 13)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- 1 -------------------------------------------------------------------------------------------


def test_chat_keeps_maximal_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    said = {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "x", 6: "abcde", 7: "xabc"}
    rows = [(c, i, "user" if i % 2 == 0 else None, t) for c, s in said.items() for i, t in enumerate(s)]
    logged = spark.createDataFrame([*rows, rows[0], (None, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = chat.maximal(chat.rolled(chat.turns(logged))).collect()
    assert {r.conv_id: (r.n_turns, r.copies) for r in got} == {4: (3, 1), 6: (5, 1), 7: (4, 1), None: (1, 1)}
    parts = {(r.conv_id, r.part): r.text for r in chat.format_chats(logged).collect()}
    assert parts[6, 2] == "<|im_start|>user\ne<|im_end|>\n" and len([k for k in parts if k[0] == 6]) == 3
    assert chat.format_chats(logged.limit(0)).count() == 0


# --- 2 -------------------------------------------------------------------------------------------


def test_media_round_trip_and_query(spark):
    for n in (0, 1, 575, 576, 577, 5000):
        p = media.padded(random.Random(n).randbytes(n))
        assert len(p) % 576 == 0 and p and media.samples(media.stored(p)) == p
    broken = bytearray(media.stored(media.padded(b"x")))
    broken[45] ^= 1
    with pytest.raises(ValueError):
        media.samples(bytes(broken))
    docs = {r.doc_id: r.text for r in table(spark, str(DATA), "documents").collect()}
    got = media.op2_media(spark, str(DATA)).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id].encode()
        p = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        s = media.stored(p)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(s), hashlib.sha256(s).hexdigest(), media.feature(p))


def test_sequences_keep_order_and_captions(spark):
    got = media.parsed('<p>a &amp; b</p><script>no</script><figure><img src="x"><img src="y"><figcaption>c <b>d</b></figcaption></figure> tail <img src=z alt=q><img>')
    assert [(x["kind"], x["text"], x["ref"], x["caption"]) for x in got] == [("text", "a & b", None, None), ("media", None, "x", "c d"), ("media", None, "y", "c d"), ("text", "tail", None, None), ("media", None, "z", "q")]
    pages = spark.createDataFrame([(1, None), (2, "<img src='sha256:ff'>")], "id long, html string")
    assert media.sequences(pages, F.col("html")).select(F.size("sequence")).collect()[0][0] == 0
    refs = spark.createDataFrame([(1, "sha256:aa"), (2, "sha256:ff")], "id long, ref string")
    facts = spark.createDataFrame([("aa", 1)], "digest string, media_bytes long")
    assert {r.id: r.media_bytes for r in media.resolved(refs, facts).collect()} == {1: 1, 2: None}


# --- 3 -------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = table(spark, str(DATA), "documents")
    got = language.identify(docs).select("lang", language.held_out().alias("h"), "_language.*").collect()
    out = [r for r in got if r.h]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in got)
    train, _ = language.training_sample(docs)
    held = {r[0] for r in docs.where(language.held_out()).select(language.normalised()).collect()} - {r[0] for r in docs.where(~language.held_out()).select(language.normalised()).collect()}
    assert not held & set(train)


def test_language_edges(spark, odd):
    got = {(r.doc_id, r.text): r._language for r in language.identify(odd).collect()}
    assert got[1, None].lang_pred == "und" and got[5, "12 !! 34"].lang_pred == "und" and got[2, ""].score == 0
    assert language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).where("_language.lang_pred != 'und'").count() == 0
    assert language.keep_language(odd).columns == odd.columns


def test_keep_language_rejects_noise_and_foreign_texts(spark):
    r = random.Random(3)
    docs = table(spark, str(DATA), "documents")
    foreign = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Все люди рождаются свободными и равными в своем достоинстве и правах", "すべての人間は生まれながらにして自由であり"]
    noise = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz  ", k=n)) for n in (20, 60, 200, 1000)]
    bad = spark.createDataFrame([(10**9 + i, x, None, "x", len(x)) for i, x in enumerate(foreign + noise)], DOCS)
    kept = {x.doc_id for x in language.keep_language(docs.select("doc_id", "text", "lang", "source", "n_chars").union(bad)).collect()}
    assert kept == {x.doc_id for x in docs.where("text rlike '\\\\p{L}'").collect()}


# --- 4 -------------------------------------------------------------------------------------------


def _shingles(text):
    w = text.encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_fingerprints_estimate_likeness(spark):
    docs = table(spark, str(DATA), "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    off = []
    for i, (k, x) in enumerate(rows):
        y = rows[(i + 1) % len(rows)][1]
        new = fingerprint.edited(x, y)
        assert got[k].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[k].n_chars == len(x)
        for other, said in ((new, got[k].near_edited), (y, got[k].near_next)):
            a, b = _shingles(x), _shingles(other)
            off.append(abs(said - len(a & b) / max(1, len(a | b))))
    assert max(off) < 0.15 and sum(off) / len(off) < 0.03


def test_fingerprint_edges(spark, odd):
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == odd.count()
    assert {r.fingerprint for r in got if r.n_chars == 0} == {""}
    single = fingerprint.fingerprints(odd.where("doc_id = 6")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    assert fingerprint.fingerprints(odd.limit(0)).count() == 0


# --- 5 -------------------------------------------------------------------------------------------


def test_best_fit_matches_brute_force():
    for seed in range(60):
        r = random.Random(seed)
        window = r.choice([8, 16, 17, 64, 4096])
        lengths = sorted((r.randint(1, window) for _ in range(150)), reverse=True)
        rooms, numbers, offsets, clock = [], [], [], 0
        for n in lengths:
            fits = [(room, -used, i) for i, (room, used) in enumerate(rooms) if room >= n]
            if fits:
                i = min(fits)[2]
            else:
                rooms.append((window, 0))
                i = len(rooms) - 1
            clock += 1
            numbers.append(i)
            offsets.append(window - rooms[i][0])
            rooms[i] = (rooms[i][0] - n, clock)
        assert packing.best_fit(lengths, window) == (numbers, offsets)


def test_tokens_equal_the_tokenizer():
    t = WordTokenizer(default_path(), spans=True)
    r = random.Random(5)
    letters = [chr(i) for i in range(33, 127)] + [chr(i) for i in range(0xA1, 0x180)] + ["́", "　", "漢", "я", "\u0085"]
    texts = ["  lead\x0bof \x1c x ", "", "<|endoftext|> it's 42nd don't", "İstanbul ﬁ é"] + [" ".join("".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(30)) for _ in range(60)]
    for x in texts:
        want = t.slow.encode(x, add_special_tokens=False)
        assert t.ids(x).tolist() == want.ids


def test_plain_words_are_encoded_at_once(monkeypatch):
    texts = ["It's l'été, isn't IT?  42 x_y\x7f", "", " ÀB don't!! ß×÷ naïve ", "日本 it's\x01 ok ok"]
    t = WordTokenizer(default_path())
    want = [t.slow.encode(x, add_special_tokens=False).ids for x in texts]
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    assert [t.ids(x).tolist() for x in texts] * 2 == [t.ids(x).tolist() for x in texts] + want
    t.release()
    monkeypatch.setattr(t, "encode", None)  # word by word: for words that are not plain alone
    assert t.ids("It's l'été, isn't IT? 42 x_y").tolist() == t.slow.encode("It's l'été, isn't IT? 42 x_y", add_special_tokens=False).ids


def test_idle_workers_keep_no_words(spark):
    t = WordTokenizer(default_path())
    t.ids("some words to keep")
    t.release()
    assert not t.known and len(t.pieces) == 1 and not len(t.flat) and t.ids("some words").tolist() == t.slow.encode("some words", add_special_tokens=False).ids


def test_packing_covers_every_id(spark, odd):
    for docs in (odd, table(spark, str(DATA), "documents")):
        t = WordTokenizer(default_path())
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        got = packing.pack(docs).collect()
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
            ids = [*t.ids(texts[r.doc_id][0]).tolist(), 2]
            assert r.doc_tokens == len(ids)
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        assert sum(r.length for r in got) == sum(len(t.ids(x)) + 1 for xs in texts.values() for x in xs)
    assert packing.pack(odd.limit(0)).count() == 0


# --- 6 -------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark, odd):
    for docs in (odd, table(spark, str(DATA), "documents")):
        got = mixing.mixed(mixing.sized(docs)).collect()
        assert len(got) == docs.count() and all(r.taken <= 2 * r.size for r in got)
        total = sum(r.size for r in got)
        by = {}
        for r in got:
            a = by.setdefault(r.source, [0, r.target, r.source_size, 0])
            a[0] += r.taken
            a[3] = max(a[3], r.size)
        assert abs(sum(a[1] for a in by.values()) - 1.5 * total) < 1e-6 * total
        for taken, target, size, largest in by.values():
            assert target <= 2 * size and abs(taken - target) <= largest
        copies = mixing.mix_documents(docs)
        assert copies.columns == docs.columns
        assert copies.count() == sum(r.times for r in got)
    assert mixing.mixed(mixing.sized(odd.limit(0))).count() == 0


# --- 7 -------------------------------------------------------------------------------------------


def test_warc_salvage():
    bodies = [bytes([65 + i]) * (10 + 37 * i) for i in range(12)]
    records = [warc.record(i, "http://a b", "response", hashlib.sha256(b).hexdigest(), len(b), None, b) for i, b in enumerate(bodies)]
    packed = [warc.member(r) + warc.EMPTY_MEMBER for r in records]
    whole = b"".join(packed)
    assert [x[2] for x in warc.salvaged(whole).records] == bodies and not warc.salvaged(whole).gaps
    assert [x[2] for x in warc.salvaged(b"".join(records)).records] == bodies
    at = len(packed[0]) + len(packed[1])
    bad = bytearray(whole)
    for i in range(at + 30, at + 40):
        bad[i] ^= 0xFF
    got = warc.salvaged(bytes(bad))
    assert [x[2] for x in got.records] == bodies[:2] + bodies[3:] and got.gaps[0][0] == at
    plain = b"".join(records)
    inside = len(records[0]) + len(records[1]) - 10
    cut = plain[:inside] + b"junk" + plain[inside:]
    got = warc.salvaged(cut)
    assert [x[2] for x in got.records] == [bodies[0], *bodies[2:]] and len(got.gaps) == 1
    got = warc.salvaged(b"xx" + whole[: -len(warc.EMPTY_MEMBER) - 5])
    assert [x[2] for x in got.records] == bodies[:-1] and [g[0] for g in got.gaps][0] == 0
    assert warc.salvaged(b"").records == [] and warc.salvaged(b"nothing").records == []


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 80
    pages = spark.createDataFrame([(1, "u", None), (2, "u", long), (3, None, long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (None, "u", long)], "page_id long, url string, html string")
    warc.write_archives(pages.withColumn("owner", F.lit("clash")), str(tmp_path / "w"))
    records, gaps = warc.read_archives(spark, str(tmp_path / "w"))
    got = sorted((str(r.p), r.record_type, r.t, r.payload_bytes) for r in records.select(warc.page_number("record_id").alias("p"), "record_type", warc.page_number("refers_to").alias("t"), "payload_bytes").collect())
    assert gaps.count() == 0
    assert got == sorted([("1", "response", None, 0), ("2", "response", None, 160), ("3", "revisit", 2, 160), ("3", "revisit", 2, 160), ("4", "response", None, 5), ("5", "response", None, 5), ("None", "revisit", 2, 160)])


def test_warc_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_BYTES", 4000)
    kind = "page_id long, url string, html string"
    big = "".join(random.Random(2).choices("abc é", k=400_000))
    pages = spark.createDataFrame([(i, "u", big if i == 3 else f"page {i} " * 30) for i in range(40)], kind)
    warc.write_archives(pages, str(tmp_path / "w"))
    records, gaps = warc.read_archives(spark, str(tmp_path / "w"))
    got = {int(r.record_id[10:-1]): bytes(r.payload).decode() for r in records.collect()}
    assert got == {r.page_id: r.html for r in pages.collect()} and gaps.count() == 0
    path = next((tmp_path / "w").glob("part-*"))
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc.gz").write_bytes(bytes(data))
    records, gaps = warc.read_archives(spark, str(tmp_path / "bad"))
    assert gaps.count() >= 1 and records.count() >= 1
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert [x.count() for x in warc.read_archives(spark, str(tmp_path / "none"))] == [0, 0]


# --- 8 -------------------------------------------------------------------------------------------


def test_attribution_by_largest_share(spark, odd):
    t = WordTokenizer(default_path())
    texts = {r.doc_id: r.text or "" for r in table(spark, str(DATA), "documents").collect()}
    got = {}
    for r in attribution.op8_token_counts(spark, str(DATA)).collect():
        got.setdefault(r.doc_id, {})[r.section_no] = r
    for k, x in itertools.islice(texts.items(), 60):
        n, q = len(x), len(x) // 4
        sections, counts = [(0, q), (q, n - q), (n - q, n)], [0, 0, 0]
        offsets = t.slow.encode(x, add_special_tokens=False).offsets
        for a, b in offsets:
            held = [max(0, min(b, e) - max(a, s)) for s, e in sections]
            counts[held.index(max(held))] += 1
        assert [got[k][i].tokens for i in range(3)] == counts and got[k][0].doc_tokens == len(offsets)
    rows = attribution.attributed(odd, attribution.quarters(F.coalesce("text", F.lit("")))).collect()
    assert len(rows) == 3 * odd.count() and sum(r.tokens for r in rows if r.doc_id == 1) == 0
    assert attribution.attributed(odd.limit(0), attribution.quarters(F.col("text"))).count() == 0


def test_attribution_of_blanks(spark):
    """White space at the ends, whether or not it separates words, against the tokenizer's own offsets; crossing tokens too."""
    t = WordTokenizer(default_path())
    r = random.Random(8)
    blanks = ["\u00a0", "\u3000", " ", "\n", "\t", "\x1c", "\x0b"]
    texts = ["", " ", "\u3000", "\u00a0 hello world\n", "\u3000 " + "hello world again " * 2]
    texts += ["".join(r.choices([*blanks, "hello", "wörld", "漢字", "antidisestablish", "x"], k=r.randint(1, 14))) for _ in range(150)]
    got = {}
    for x in attribution.attributed(docs_of(spark, list(enumerate(texts))), attribution.quarters(F.col("text"))).collect():
        got.setdefault(x.doc_id, {})[x.section_no] = (x.tokens, x.crossing)
    for k, x in enumerate(texts):
        n, q = len(x), len(x) // 4
        sections, counts = [(0, q), (q, n - q), (n - q, n)], [[0, 0] for _ in range(3)]
        for a, b in t.slow.encode(x, add_special_tokens=False).offsets:
            held = [max(0, min(b, e) - max(a, s)) for s, e in sections]
            at = held.index(max(held))
            counts[at][0] += 1
            counts[at][1] += sum(h > 0 for h in held) > 1
        assert [list(got[k][i]) for i in range(3)] == counts, repr(x)


# --- 9 -------------------------------------------------------------------------------------------


def _linked(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_links_find_every_near_pair(spark):
    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for p in prints for _ in range(8)] + [0, (1 << 64) - 1]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    assert {(x.a, x.b) for x in simhash.links(df, len(signed)).collect()} == want


def test_wide_segments_find_every_near_pair(spark):
    r = random.Random(4)
    prints = [r.getrandbits(62) for _ in range(6)]
    signed = sorted({p ^ sum(1 << b for b in r.sample(range(62), k)) for p in prints for k in (0, 2, 4, 5)})
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if (a ^ b).bit_count() <= 4}
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    assert {(x.a, x.b) for x in simhash.links(df, 1 << 26).collect()} == want


def test_simhash_components(spark, odd):
    import xxhash

    docs = table(spark, str(DATA), "documents")
    got = {r.doc_id: r for r in simhash.op9_simhash(spark, str(DATA)).collect()}
    prints = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        k = min(4, len(w))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(len(w) - k + 1)] if w else []
        prints[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {k: r.component_id for k, r in got.items()} == _linked(near, prints)
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id = 2").count() == 0
    assert simhash.near_duplicates(simhash.fingerprints(odd.limit(0))).count() == 0
    t, u = "one text of a few words only", "and another of quite other words"
    repeated = docs_of(spark, [(1, t), (3, u), (3, t), (None, t), (None, "no id"), (None, "no id"), (4, u), (4, "a third")])
    assert sorted((str(r.doc_id), r.text) for r in simhash.keep_first(repeated).collect()) == [("1", t), ("3", u), ("4", "a third"), ("None", "no id")]


def test_links_send_no_probes_through_the_driver(spark):
    prints = written(spark.range(50).select((F.col("id") * 7).alias("fp")), "prints")
    assert "Broadcast" not in simhash.links(prints, 50)._jdf.queryExecution().executedPlan().toString()


def test_components_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(shared, "WHOLE_ROWS", 3)
    found = components.components(spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21)], "a long, b long")).collect()
    assert {r.node: r.component for r in found} == dict.fromkeys(range(1, 10), 1) | {20: 20, 21: 20}
    edges = shared.merged(spark.range(9), 4).join(spark.range(9), "id")
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()


def test_components_of_a_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


# --- 10 ------------------------------------------------------------------------------------------


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _near(docs, edits, min_chars):
    """Pairs of doc_ids whose only lines are near."""
    unique = written(lines.distinct_lines(docs, edits, min_chars), "lines")
    return {tuple(sorted((int(x.first_a) >> 63, int(x.first_b) >> 63))) for x in lines.near_pairs(docs, unique, edits, min_chars).collect()}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_join_finds_every_pair(spark, edits):
    r = random.Random(edits)
    base = ["".join(r.choices("abcdé ", k=r.randint(32, 60))) for _ in range(12)]
    texts = set(base)
    for x in base:
        for k in range(1, edits + 2):
            y = list(x)
            for _ in range(k):
                at = r.randrange(len(y))
                y[at : at + 1] = r.choice([[], ["z"], [y[at], "z"]])
            texts.add("".join(y))
    texts = [x for x in sorted(texts) if len(x) >= 32]
    docs = docs_of(spark, list(enumerate(texts)))
    got = _near(docs, edits, 32)
    assert got == {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if _distance(a, b) <= edits}


def test_line_dedup(spark, odd):
    a, b = "a line that is long enough to be looked at", "another line that is long enough to count"
    docs = docs_of(spark, [(1, f"{a}\nshort\n{b}"), (2, f"{a}!\nshort\n{b}\ntail"), (3, a), (4, None), (5, ""), (5, "")])
    got = {r.doc_id: r.text for r in lines.cleaned(docs.withColumn("rk", F.lit(1))).collect()}
    assert got == {1: f"{a}\nshort\n{b}", 2: "short\ntail", 3: "", 4: None, 5: ""}
    assert lines.cleaned(docs).count() == 6 and lines.cleaned(docs.limit(0)).count() == 0
    assert lines.cleaned(odd).count() == odd.count()


def test_line_dedup_takes_short_lines(spark):
    a, b = "All rights reserved.", "All rights reserved"
    docs = docs_of(spark, [(1, f"{a}\nyes\n\n \nno"), (2, f"{b}\nyes\n\n \nnot"), (3, "yes"), (4, f"{a}\n\n再见")])
    got = {r.doc_id: r.text for r in lines.cleaned(docs, min_chars=lines.ALL_LINES).collect()}
    assert got == {1: f"{a}\nyes\n\n \nno", 2: "\n \nnot", 3: "", 4: "\n再见"}


def test_op10_takes_equal_lines_of_any_length(spark):
    docs = table(spark, str(DATA), "documents").collect()
    got = {r.doc_id: r.dropped_lines for r in lines.op10_line_dedup(spark, str(DATA)).collect()}
    seen, least = set(), {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        for x in (r.text or "").split("\n"):
            if x.strip():
                least[r.doc_id] = least.get(r.doc_id, 0) + (x in seen)
                seen.add(x)
    assert sum(least.values()) and all(got[k] >= n for k, n in least.items())


@pytest.mark.parametrize("edits", [1, 3])
def test_edit_join_by_length_class(spark, edits):
    r = random.Random(edits)
    texts = set()
    for n in [8, 15, 16, 17, 18, 24, 30, 31, 32, 33, 34, 35, 60]:
        x = "".join(r.choices("abcdé", k=n))
        texts.add(x)
        for k in (1, 1, 2, 3, 3, 4):
            y = list(x)
            for _ in range(k):
                at = r.randrange(len(y))
                y[at : at + 1] = r.choice([[], ["z"], [y[at], "z"]])
            texts.add("".join(y))
    texts = sorted(texts)
    docs = docs_of(spark, list(enumerate(texts)))
    got = _near(docs, edits, 1)
    most = lambda n: edits if n >= 32 else 1 if n >= 16 else 0
    assert got == {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if _distance(a, b) <= most(min(len(a), len(b)))}


@pytest.mark.parametrize(("edits", "levels"), [(1, 3), (2, 2), (3, 3)])
def test_edit_join_of_hot_keys(spark, monkeypatch, edits, levels):
    """Hundreds of lines that share most of their text, some of them near: keys beyond HOT are cut anew."""
    monkeypatch.setattr(lines, "LEVELS", levels)
    monkeypatch.setattr(lines, "HOT", 4)
    r = random.Random(edits)
    texts = set()
    for base in ("posted by somebody on some day of the year in a place that has no name, see below", "a short line of about 34 characters"):
        for _ in range(80):
            x = list(base)
            for _ in range(r.randint(0, 6)):
                at = r.randrange(len(x))
                x[at : at + 1] = r.choice([[], ["z"], [x[at], "é"], list("other word")])
            texts.add("".join(x))
    texts = sorted(texts)
    docs = docs_of(spark, list(enumerate(texts)))
    most = lambda n: edits if n >= 32 else 1 if n >= 16 else 0
    assert _near(docs, edits, 1) == {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if abs(len(a) - len(b)) <= edits and _distance(a, b) <= most(min(len(a), len(b)))}


def test_rests_of_hot_keys_are_cut_by_their_own_edits(spark):
    line = "".join(random.Random(5).choices("abcdefgh", k=80))
    texts = spark.createDataFrame([(1, line, len(line))], "id long, line string, n int")
    live = spark.createDataFrame([(10 + c, 1, c) for c in range(8)], "key long, id long, code int")
    again = lines._again(lines._rest(live, texts, 3, 1), texts, 3, 1).collect()
    # Two of eight keys leave three edits beside them (8 substrings and 4 of another class), six leave two (5 and more); cut for three, all made 96.
    assert len(again) == 66


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    r = random.Random(edits)
    pairs = []
    for _ in range(600):
        a = "".join(r.choices("ab\U0001f600é", k=r.randint(1, 14)))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(b) + 1)
            b[at : at + 1] = r.choice([[], ["z"], ["a", "b"]])
        if b and abs(len(a) - len(b)) <= edits:
            pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for x in df.select("a", "b", lines.distance(F.col("a"), F.col("b"), edits).alias("d")).collect():
        assert min(x.d, edits + 1) == min(_distance(x.a, x.b), edits + 1)


def test_line_dedup_edges(spark, odd):
    rows = [(None, "a line that has no id but many characters"), (7, "a line that has no id but many characters"), (None, "only here, though without an id as well"), (8, None), (8, "x" * 70_000), (9, "x" * 70_001), (10, "same id, one text of two or more"), (10, "same id, one text of two or more\nmore")]
    docs = docs_of(spark, rows)
    clash = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["dropped", "did", "th", "pos", "line", "n", "h1", "h2", "salt", "_gone", "first", "key", "id"])])
    for d, into in ((docs, "dropped"), (clash, None), (odd, None)):
        out = lines.cleaned(d, min_chars=1, into=into)
        assert out.columns == [*[c for c in d.columns if c != into], *([into] if into else [])] and out.count() == d.count()
    got = sorted((str(r.doc_id), str(r.text)) for r in lines.cleaned(clash, min_chars=1).collect())
    kept = [("None", ""), ("7", rows[0][1]), ("None", rows[2][1]), ("8", "None"), ("8", "x" * 70_000), ("9", "")]
    # of two documents with one id either may be the earlier one: it is told by the hash of the text
    assert got in (sorted([*kept, ("10", rows[6][1]), ("10", "more")]), sorted([*kept, ("10", ""), ("10", rows[7][1])]))


def test_line_dedup_takes_three_edits_by_default(spark):
    a = "a line that is long enough to be looked at by the edit join"
    docs = docs_of(spark, [(1, a), (2, a.replace("looked", "locked")), (3, a.replace("long", "lung").replace("edit", "exit") + "!"), (4, a.replace("looked at", "gone"))])
    assert {r.doc_id: r.text for r in lines.cleaned(docs).collect()} == {1: a, 2: "", 3: "", 4: a.replace("looked at", "gone")}


def test_warc_salvage_of_mixed_files():
    r = random.Random(7)
    bodies = [r.randbytes(300) + bytes([65 + i]) for i in range(8)]
    bodies[0] = bodies[5] = warc.member(b"a gzip body")
    records = [warc.record(i, "u", "response", hashlib.sha256(b).hexdigest(), len(b), None, b) for i, b in enumerate(bodies)]
    damage = lambda x, at: x[:at] + bytes([x[at] ^ 0xFF]) + x[at + 1 :]
    read = lambda data: [x[2] for x in warc.salvaged(data).records]
    bad = damage(records[1], len(records[1]) - 20)
    # plain records behind a gzip body and a damaged record
    assert read(records[0] + bad + b"".join(records[2:])) == [bodies[0], *bodies[2:]]
    assert read(records[1] + damage(records[0], len(records[0]) - 8) + b"".join(records[2:])) == [bodies[1], *bodies[2:]]
    # members and plain records in turn, a damaged member before plain ones
    mixed = [warc.member(x) if i % 2 else x for i, x in enumerate(records)]
    assert read(b"".join(mixed)) == bodies and not warc.salvaged(b"".join(mixed)).gaps
    mixed[3] = damage(mixed[3], len(mixed[3]) // 2)
    assert read(b"".join(mixed)) == bodies[:3] + bodies[4:]
    # a cut or damaged member keeps what was inflated before, whether packed or stored
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = z.compress(b"".join(records[:4])) + z.flush()
    for many in (warc.member(b"".join(records[:4])), stored):
        assert read(many[:-200] + records[6]) == [*bodies[:3], bodies[6]]
        assert read(damage(many, len(many) - 6) + warc.member(records[6])) == [*bodies[:4], bodies[6]]
        assert read(damage(many, len(many) - 150) + warc.member(records[6])) == [*bodies[:3], bodies[6]]
        assert len(warc.salvaged(many[:-200]).gaps) >= 1
    # a bad record between good ones in a member is a gap
    got = warc.salvaged(warc.member(records[0] + bad + records[2] + bad + records[3]))
    assert [x[2] for x in got.records] == [bodies[0], bodies[2], bodies[3]] and len(got.gaps) == 2
    # without a digest nothing proves a record of a damaged member
    bare = warc.member(2 * b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert read(bare[:-3]) == [b"abc", b"abc"] and read(damage(bare, len(bare) - 6)) == []


def test_blank_lines_are_those_of_white_space(spark):
    texts = [chr(c) + x for c in range(0x3001) for x in ("", lines.BLANKS)] + ["", lines.BLANKS]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    blank = F.ltrim("line", F.lit(lines.BLANKS)) == ""
    assert df.where(blank == F.col("line").rlike(r"\S")).count() == 0
