"""Corpus operators against brute force, round trips and the cases each names in its docstring."""

import collections
import hashlib
import html
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidegate.llm import bpe, decontam, html_text, lang_id, media_ts, near_dedup, secrets, sharding, substring_dedup, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPEC = bpe.read_spec(PATH)
WORDS = "the of and to in that it with for on as at by from or an be this which one had not but what all were".split()
ODD = [None, "", " ", "\n\n", "a", "Wort " * 3000, "日本語 🎉 don't\x00\x1c", "<|endoftext|> x", "x" * 5000]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = list(ODD)
    for _ in range(30):
        out.append(prose(rng, rng.randint(3, 120)) + ".")
    base = prose(rng, 200).split()
    for k in range(6):
        w = list(base)
        w[k * 7] = "changed"
        out.append(" ".join(w))
    return out + [out[12], out[12]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 0, "extra", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, spans string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_bpe_is_the_library(spark, docs, empty, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    out = {r.doc_id: r for r in bpe.encode_decode(docs, SPEC).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert out[i].ids is None and out[i].decoded is None
            continue
        want = lib.encode(t, add_special_tokens=False).ids
        assert out[i].ids == want and out[i].decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(empty, SPEC).count() == 0


def test_bpe_long_and_short_trees_agree():
    b, rng = bpe.ByteBPE(SPEC), random.Random(1)
    words = [bytes(rng.choice(b"aeinrst ") for _ in range(rng.randint(1, 32))) for _ in range(500)]
    assert b._encode_short(words) == [b.encode_long(w) for w in words]
    assert b.decode([255, 199]) == "�\x0b"


def brute_secrets(x):
    a = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    o = [(m.start(), 0, "assign", m.end()) for m in a.finditer(x) if len(m[2]) >= 8]
    o += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    o += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(o))


SECRETS = ["token: 'abcdefgh12'", "é secret=token:short ApiKey==" + "q" * 9, "AKIA" + "Z" * 12 + " " + "ab12" * 9 + "x", "password = \"abcd1234\" passwd:abcdefghi", "token=abc token=abc", None, "", "🎉 API_KEY=12345678"]


def test_secret_spans_and_ledger(spark, tmp_path):
    rows = [(i, t, 1) for i, t in enumerate(SECRETS + SECRETS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob int")
    out = {r.doc_id: r.s for r in secrets.scan_documents(df, ["doc_id"]).select("doc_id", secrets.listed(F.col("spans")).alias("s")).collect()}
    assert out == {i: brute_secrets(t or "") for i, t, _ in rows}
    assert secrets.scan_documents(df.limit(0), ["doc_id"]).count() == 0
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    first = ledger.commit("a", df.filter("doc_id < 3"))
    assert first.count() == 3
    assert ledger.commit("a", df).count() == 3  # a replay changes nothing
    seen = {r.blob for r in first.collect()}
    new = secrets.scan(df, ledger=ledger.rows())
    assert not seen & {r.blob for r in new.collect()}
    assert ledger.commit("b", df).count() == len({hashlib.sha256((t or "").encode()).hexdigest() for t in SECRETS})
    other = secrets.scan(df, version="next", ledger=ledger.rows())
    assert other.count() == ledger.rows().count()  # a new rule version scans every blob again
    red = secrets.scan_documents(df.withColumn("t", F.col("text")), ["t"]).select(secrets.redact(F.col("t"), F.col("spans")).alias("r"))
    assert not any(r.r and secrets_in(r.r) for r in red.collect())


def secrets_in(x):
    return brute_secrets(x)


def test_token_rollup(spark, docs, tmp_path):
    versions = {"bpe": SPEC, "words-1": ""}
    rows = token_counts.counted(docs, versions)
    store = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0
    assert store.commit("one", token_counts.inserts(rows))
    assert not store.commit("one", token_counts.inserts(rows))
    total = {r.tokenizer: (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    texts = [r.text for r in docs.collect()]
    b = bpe.ByteBPE(SPEC)
    assert total["bpe"] == (len(texts), sum(len(x) // 4 for x in b.encode_batch(texts)))
    assert total["words-1"] == (len(texts), sum(len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")) for t in texts))
    half = token_counts.counted(docs.filter("doc_id % 2 = 0"), versions)
    store.commit("two", token_counts.deletes(half))
    moved = token_counts.counted(docs.filter("doc_id % 2 = 1").withColumn("source", F.lit("t")), versions)
    store.commit("three", token_counts.revisions(token_counts.counted(docs.filter("doc_id % 2 = 1"), versions), moved))
    assert {(r.source, r.tokenizer, r.n_docs) for r in store.totals().collect()} == {("t", "bpe", len(texts) // 2), ("t", "words-1", len(texts) // 2)}
    with pytest.raises(ValueError):
        store.commit("../x", token_counts.inserts(rows))
    plan = token_counts.rolled(token_counts.inserts(rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan  # each text is counted once


def brute_dedup(rows):
    spans = {i: substring_dedup.spans(t) if t else [] for i, t in rows}
    first = {}
    for i in sorted(spans):
        for h, a, b, _ in spans[i]:
            first.setdefault(h, (i, a, b))
    out = {}
    for i, t in rows:
        gone = [(a, b) for h, a, b, _ in spans[i] if first[h] != (i, a, b)]
        out[i] = substring_dedup.without(t, gone)[0] if t and gone else t
    return out


def test_substring_dedup(spark, empty):
    rng = random.Random(2)
    passage = " ".join(prose(rng, 14).capitalize() + "." for _ in range(5))
    own = [". ".join(prose(rng, 13).capitalize() for _ in range(4)) + "." for _ in range(6)]
    texts = [own[0] + " " + passage, None, own[1], passage + " " + own[2], "", own[3] + "\n" + passage + "\n" + own[4], own[5] + " " + own[5], own[1]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in substring_dedup.deduplicate(df).collect()}
    assert out == brute_dedup(rows)
    assert out[0] == texts[0] and out[2] == texts[2] and out[1] is None and out[7] == ""
    assert passage[:40] not in out[3] and own[2] in out[3] and own[4] in out[5]
    assert substring_dedup.deduplicate(empty).count() == 0


def test_substring_dedup_null_and_repeated_ids(spark):
    rng = random.Random(21)
    own = [". ".join(prose(rng, 13).capitalize() for _ in range(4)) + "." for _ in range(8)]
    passage, other = own[6], own[7]
    rows = [(1, passage), (None, passage + " " + own[0]), (None, own[1]), (7, passage + " " + own[2]), (7, own[3]), (None, own[4] + " " + other), (None, own[5] + " " + other), (8, own[0] + " x."), (9, "alone"), (9, "alone"), (None, None), (None, "")]
    copies = [(3, "Copy of one text. " + prose(rng, 20) + "."), (None, "Copy of no id. " + prose(rng, 20) + ".")]
    df = spark.createDataFrame(rows + [c for c in copies for _ in range(3)], "doc_id long, text string").repartition(3)
    out = collections.Counter((r.doc_id, r.text) for r in substring_dedup.deduplicate(df).collect())
    want = collections.Counter([(1, passage), (None, own[1]), (7, own[2]), (7, own[3]), (8, own[0] + " x."), (9, "alone"), (9, "alone"), (None, None), (None, "")])
    want.update(copies + [(c[0], "") for c in copies for _ in range(2)])
    # a passage of rows without an id stays in one of them
    a, b = [(None, own[4] + " " + other), (None, own[5] + " ")], [(None, own[4] + " "), (None, own[5] + " " + other)]
    assert out in (want + collections.Counter([(None, ""), *a]), want + collections.Counter([(None, ""), *b]))


def test_substring_dedup_one_sentence(spark):
    rng = random.Random(22)
    line, whole, short = prose(rng, 60), prose(rng, 30) + ".", "Too short to be a span."
    signs = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    chinese = "".join(signs(9) + "。" for _ in range(5))
    own = [signs(20) + "。" for _ in range(4)]
    # the ends of the passage merge with the host's sentences, so one whole sentence is left of it
    ends = [prose(rng, 8) + ". " + whole + " " + prose(rng, 8) for _ in range(2)]
    texts = [line, line, whole, short, short, own[0] + chinese + own[1], own[2] + chinese + own[3], *ends]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in substring_dedup.deduplicate(df).collect()}
    want = dict(enumerate(texts)) | {1: "", 6: own[2] + own[3]} | {7 + k: ends[k].replace(whole + " ", "") for k in range(2)}
    assert out == want


def test_language_held_out(spark):
    rng = random.Random(3)
    parts = {"en": "th er ing on and the of", "de": "sch ung ein der die keit ver", "fr": "eau tion les oi ré que", "es": "ción ado que mente los ñ"}
    rows = []
    for i in range(400):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(30)), lang))
    rows += [(1000, None, "en"), (1001, "123 ...", "en"), (1002, "", None), (1003, "der ein schkeit", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in lang_id.identify(df, ["doc_id"]).collect()}
    held = [(i, lang) for i, _, lang in rows[:400] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(out[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1003].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out.values())
    again = {r.doc_id: r.lang_pred for r in lang_id.identify(df.repartition(5), ["doc_id"]).collect()}
    assert again == {i: r.lang_pred for i, r in out.items()}
    assert lang_id.identify(df.limit(0), ["doc_id"]).count() == 0
    none = lang_id.identify(df.withColumn("lang", F.lit(None).cast("string")), ["doc_id"])
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_shards_are_exact(spark, docs, empty, texts):
    df = docs.unionByName(docs.filter("doc_id < 5"))
    out = sharding.shard_documents(df, 7).collect()
    n = collections.Counter(r.shard for r in out)
    assert len(out) == len(texts) + 5 and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n[s]))
    by_id = {i: t for i, t in enumerate(texts)}
    for r in out:
        raw = (by_id[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    again = sharding.shard_documents(df.repartition(9), 7).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    assert sharding.shard_documents(empty).count() == 0


def test_hypergeometric_law():
    rng = random.Random(7)
    for good, bad, draws in ((5, 7, 6), (400, 900, 300), (10**12, 3 * 10**12, 10**9)):
        xs = [sharding.hypergeometric(rng, good, bad, draws) for _ in range(3000)]
        mean = draws * good / (good + bad)
        var = mean * bad / (good + bad) * (good + bad - draws) / (good + bad - 1)
        assert abs(sum(xs) / len(xs) - mean) < 5 * (var / len(xs)) ** 0.5
        assert all(max(0, draws - bad) <= x <= min(good, draws) for x in xs)
    m = sharding.matrix([10, 0, 33, 7], 4, 1)
    assert [sum(r) for r in m] == [10, 0, 33, 7] and max(map(sum, zip(*m))) - min(map(sum, zip(*m))) <= 1


def test_transport_streams(spark, docs, empty):
    df = docs.select("doc_id", "text").withColumn("payload", media_ts.padded(F.col("text")))
    out = df.withColumn("media", media_ts.to_media(F.col("payload"))).withColumn("p", media_ts.parse_media(F.col("media"))).collect()
    for r in out:
        raw = (r.text or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert bytes(r.payload) == want and bytes(r.p.payload) == want
        assert len(r.media) % 188 == 0 and r.p.programs == 1 and r.p.counter_faults == r.p.table_faults == r.p.damaged == 0
        assert all(u.random_access for u in r.p.units) and [u.pts for u in r.p.units] == [k * 34560 for k in range(len(r.p.units))]
    media = media_ts.mux(bytes(range(256)) * 40)
    lost = media_ts.demux(media[: 188 * 5] + media[188 * 6 :])
    assert lost.counter_faults == 1
    bad = bytearray(media)
    bad[10] ^= 1
    assert media_ts.demux(bytes(bad)).table_faults == 1
    assert media_ts.demux(b"nonsense" * 50).damaged == 2
    assert df.limit(0).withColumn("media", media_ts.to_media(F.col("payload"))).count() == 0


def brute_contamination(text, items):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(str.maketrans(decontam.UPPER, decontam.LOWER)))
    w, hit, which = find(text), set(), set()
    for i, t in items:
        v = find(t)
        n = min(10, len(v))
        grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
        for j in range(len(w) - n + 1) if n else ():
            if tuple(w[j : j + n]) in grams:
                hit.update(range(j, j + n))
                which.add(str(i))
    return len(w), len(hit), sorted(which)


def test_decontamination(spark, empty):
    rng = random.Random(4)
    items = [(k, prose(rng, n)) for k, n in ((1, 30), (20, 12), (3, 10), (4, 6), (5, 3), (6, 1))] + [(7, None), (8, "!?"), (9, "a a a a a a a a a a a a")]
    items += [(10, items[0][1][:90])]
    texts = [items[0][1].upper(), "x " + " ".join(items[0][1].split()[3:14]) + " y", items[1][1][5:], None, "", items[3][1] + " z", "a " * 300, prose(rng, 60), items[5][1], "Éa " + items[2][1] + ". " + items[4][1]]
    rows = [(i, t) for i, t in enumerate(texts + texts[:3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    out = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(df, bench, ["doc_id"]).collect()}
    assert out == {i: brute_contamination(t, items) for i, t in rows}
    assert decontam.contamination(empty, bench, ["doc_id"]).count() == 0
    none = decontam.contamination(df, bench.limit(0), ["doc_id"]).collect()
    assert all(r.n_hit == 0 for r in none) and len(none) == len(rows)


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                same = sets[a] == sets[b] or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
                if same and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_near_duplicates(spark, docs, empty, texts):
    rng = random.Random(9)
    chain = [prose(rng, 150).split()]
    for _ in range(8):
        w = list(chain[-1])
        w[rng.randrange(150)] = "edited"
        w[rng.randrange(150)] = "altered"
        chain.append(w)
    rows = list(enumerate(texts)) + [(100 + k, " ".join(w)) for k, w in enumerate(chain)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit(0))
    out = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert out == brute_classes(rows)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    rng = random.Random(11)
    base = prose(rng, 80).split()
    rows = []
    for k in range(60):
        w = list(base)
        w[rng.randrange(80)] = f"w{k}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(near_dedup, "BLOCK", 1000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert out == brute_classes(rows)


def test_blocks_when_no_member_is_near_the_leader(spark, monkeypatch):
    """One bucket holds everything, so all links but the leader's are found in blocks, and the triangle inequality drops none."""
    rng = random.Random(21)
    rows, k = [], 0
    for _ in range(12):
        base = prose(rng, 100).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(100)] = f"w{k}"
            rows.append((k, " ".join(w)))
            k += 1
    rng.shuffle(rows)
    monkeypatch.setattr(near_dedup, "BLOCK", 1500)
    monkeypatch.setattr(near_dedup, "VERTICES", 10)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_dedup, "band_keys", lambda text: F.array(F.lit(1).cast("bigint")))
    out = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert out == brute_classes(rows)


def test_hot_groups_are_dealt_over_parts(spark, monkeypatch):
    """Many copies, a band key of all texts and leaders of many members, each met in several parts."""
    rng = random.Random(31)
    rows = []
    for g in range(4):
        base = prose(rng, 80).split()
        for _ in range(8):
            w = list(base)
            w[rng.randrange(80)] = f"g{g}w{rng.randrange(4)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(100 + k, rows[0][1]) for k in range(9)]
    monkeypatch.setattr(near_dedup, "MEMBERS", 2)
    bands = near_dedup.band_keys
    monkeypatch.setattr(near_dedup, "band_keys", lambda text: F.concat(bands(text), F.array(F.lit(1).cast("bigint"))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert out == brute_classes(rows)


def test_near_duplicates_null_and_repeated_ids(spark):
    rng = random.Random(14)
    base = [prose(rng, 80) for _ in range(4)]
    near = [b + " more" for b in base]
    rows = [(5, base[0]), (None, near[0]), (None, prose(rng, 70)), (None, prose(rng, 70)), (6, base[1]), (9, prose(rng, 70)), (9, near[1]), (9, prose(rng, 70)), (None, base[2]), (None, near[2]), (3, base[3]), (3, near[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(df).collect()
    want = [(5, 5), (None, 5), (None, None), (None, None), (6, 6), (9, 9), (9, 6), (9, 9), (None, None), (None, None), (3, 3), (3, 3)]
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == collections.Counter(want)
    sizes = collections.Counter((r.cv, r.ca, r.cb) for r in near_dedup.classes(df).collect())
    assert sorted(sizes.values()) == [1, 1, 1, 1, 2, 2, 2, 2]


def test_bands_find_near_texts_with_a_repeated_line():
    rng = random.Random(15)
    for k in range(30):
        base = " ".join(f"a{rng.randrange(10**9)}" for _ in range(84))
        line = " ".join(f"b{rng.randrange(10**9)}" for _ in range(12))
        h, doc, n = near_dedup.shingles([base, base + (" " + line) * 1000, ""])
        sets = [set(h[doc == i]) for i in range(2)]
        assert len(sets[0] & sets[1]) >= near_dedup.THRESHOLD * len(sets[0] | sets[1])
        keys, number = near_dedup.keys_of(h, doc, n, 3)
        assert number.tolist() == [near_dedup.BANDS, 2 * near_dedup.BANDS, 0]
        assert set(keys[: near_dedup.BANDS]) & set(keys[near_dedup.BANDS :])


def test_prob_min_hash_estimates_jaccard():
    rng = random.Random(13)
    base = prose(rng, 400).split()
    other = base[:300] + prose(rng, 100).split()
    h, doc, n = near_dedup.shingles([" ".join(base), " ".join(other)])
    sets = [set(h[doc == 0]), set(h[doc == 1])]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    sig = near_dedup.signatures(h, doc, n, 2)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.17


PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home<li>About</ul></nav><div class='x'><p>Follow us on all the channels</div><div><h1>{0}</h1><p>{1} a &amp; <b>b</b>c<p>{2}<div class=comments>no</div><script>var a='<p>';</script></div><footer>f</footer>"


def test_html_main_text(spark):
    rng = random.Random(6)
    pages = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(prose(rng, 3), prose(rng, 20), prose(rng, 10))) for i in range(24)]
    pages += [(100, None, None), (101, "x", ""), (102, "http://h0.org/z", "<article><h1>T</h1>x<br>y <p>u&lt;v</article><aside>no</aside>"), (103, "http://h0.org/b", "<p>cut <b"), (104, "http://h1.org/c", "plain & text")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    out = {r.page_id: r.text for r in html_text.extract_pages(df, ["page_id", "url"]).collect()}
    for i, _, p in pages[:24]:
        main = re.search(r"<h1>.*?(?=<div class=comments)", p, re.S)[0]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", main))).split())
        assert out[i] == want
    assert out[100] == "" and out[101] == "" and out[102] == "T x y u<v" and out[104] == "plain & text"
    assert html_text.extract_pages(df.limit(0), ["page_id"]).count() == 0


def test_article_paragraphs_that_recur_stay(spark):
    rows = [(i, "http://h/", f"<article><h1>{i}</h1><p>A passage that everyone quotes.</p><p>own {i}</p></article>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all("everyone quotes" in r.text for r in html_text.extract_pages(df, ["page_id"]).collect())


def test_html_deep_and_named_sections():
    assert html_text.main_text("<div>" * 100_000 + "deep") == "deep"
    assert html_text.main_text("<p>a" + "<b>" * 50_000 + "b" + "<div>c</div>" * 500 + "</i>" * 5000).startswith("ab c")
    page = '<article><h1>T</h1><section id="related-work"><p>Prior studies.</p></section><p class="alert">kept</p><div class="share-bar">like</div><p class="ad">buy</p></article>'
    assert html_text.main_text(page) == "T Prior studies. kept"
    assert html_text.main_text("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == "a b c d e f g"


def test_templates_decide_without_articles(spark):
    """Blocks without telling names, on pages without article or main: held against a count of equal blocks for each host."""
    rng = random.Random(31)
    pages, want = [], {}
    for h, size in enumerate((3, 8, 40, 90)):
        common = [f"<div class='x{k}'><p>{prose(rng, 8)}</p></div>" for k in range(4)]
        drawn = []
        for n in range(size):
            own = [f"<div><p>{prose(rng, 12)} {h}-{n}</p></div>" for _ in range(2)]
            blocks = own + [c for k, c in enumerate(common) if rng.random() < (0.9, 0.5, 0.3, 0.08)[k]]
            rng.shuffle(blocks)
            drawn.append(blocks)
        for n, blocks in enumerate(drawn):
            seen = [sum(b in other for other in drawn) for b in blocks]
            left = [b for b, k in zip(blocks, seen, strict=True) if size < 5 or k < 5 or k < 0.25 * size]
            url = f"http://h{h}.example/{n}"
            pages.append((len(pages), url, "<html><body>" + "".join(blocks) + "</body></html>"))
            want[url] = " ".join(re.sub("<[^>]*>", "", b) for b in left)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = {r.url: r.text for r in html_text.extract_pages(df, ["url"]).collect()}
    assert got == want
    assert sum(html_text.main_text(p) != want[u] for _, u, p in pages) > 100  # what templates change


def test_transport_stream_goes_on_after_lost_step():
    payload = bytes(random.Random(4).randrange(256) for _ in range(30_000))
    media = media_ts.mux(payload)
    cut = media[: 188 * 40 + 90] + b"\x47" + media[188 * 40 + 90 :]
    p = media_ts.demux(cut)
    got = b"".join(p.streams[media_ts.DATA_PID].parts)
    assert p.damaged and len(got) >= len(payload) - 2 * media_ts.UNIT and got[:3072] == payload[:3072] and got[-3000:] == payload[-3000:]
    lost = media_ts.demux(media[: 188 * 40] + media[188 * 40 + 50 :])
    assert b"".join(lost.streams[media_ts.DATA_PID].parts)[-3000:] == payload[-3000:]
    assert media_ts.demux(b"x" * 1000).packets == 0 and media_ts.demux(b"").packets == 0


def test_transport_stream_tables_over_packets_and_stamps():
    """A program map of 60 streams takes two packets; stamps and clock are read back."""
    streams = b"".join(bytes([6]) + (0xE000 | 0x200 + k).to_bytes(2, "big") + b"\xf0\x00" for k in range(60))
    body = (0xE000 | 0x200).to_bytes(2, "big") + b"\xf0\x00" + streams
    sec = media_ts.section(2, 1, body)
    packet = lambda pid, start, n, data: bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, 0x10 | n]) + data + b"\xff" * (184 - len(data))
    pat = media_ts.section(0, 1, (1).to_bytes(2, "big") + (0xE000 | 0x1000).to_bytes(2, "big"))
    pes = b"\x00\x00\x01\xbd" + (13 + 4).to_bytes(2, "big") + b"\x80\xc0\x0a" + media_ts.time_stamp(3, 5000) + media_ts.time_stamp(1, 4000) + b"data"
    field = bytes([183 - len(pes), 0x50]) + bytes([0, 0, 0, 50, 0x7E, 7]) + b"\xff" * (176 - len(pes))
    data = bytes([0x47, 0x40 | 2, 0x05, 0x30]) + field + pes
    assert len(data) == 188 and 183 < len(sec)
    media = packet(0, True, 0, b"\x00" + pat) + packet(0x1000, True, 0, b"\x00" + sec[:183]) + packet(0x1000, False, 1, sec[183:]) + data
    p = media_ts.demux(media)
    assert len(p.streams) == 60 and not p.table_faults and not p.damaged
    assert p.streams[0x205].units == [(5000, True, 4, 4000, 100 * 300 + 7)] and p.streams[0x205].parts == [b"data"]
    missing = media_ts.demux(media[:376] + media[564:])
    assert not missing.streams and missing.table_faults


def test_every_run_of_sentences(spark):
    """The operator against hashing literally every run of consecutive sentences, with an own way to cut sentences."""
    rng = random.Random(41)
    pool = [" ".join(prose(rng, rng.randint(2, 9)).split()) + "." for _ in range(25)]
    rows = []
    for i in range(30):
        out = []
        while len(out) < 12:
            k = rng.randrange(len(pool))
            out += pool[k : k + rng.randint(1, 5)] if rng.random() < 0.4 else [prose(rng, rng.randint(2, 9)) + "."]
        rows.append((i, " ".join(out)))
    cut = {i: [s.strip() for s in re.findall(r"[^.]*\.", t)] for i, t in rows}
    places = collections.defaultdict(list)
    for i, s in cut.items():
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                words = sum(len(x.split()) for x in s[a:b])
                if b - a >= 2 and words >= 12 or b - a == 1 and words >= 24:
                    places[tuple(s[a:b])].append((i, a, b))
    gone = collections.defaultdict(set)
    for found in places.values():
        for i, a, b in found[1:]:
            gone[i] |= set(range(a, b))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.text.split(), r.n_removed) for r in substring_dedup.deduplicate(df).collect()}
    assert got == {i: (" ".join(x for k, x in enumerate(s) if k not in gone[i]).split(), len(gone[i])) for i, s in cut.items()}
    assert sum(n for _, n in got.values()) > 20


def test_equal_rows_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 100)
    df = spark.createDataFrame([(7, "same")] * 1500 + [(None, None)] * 300 + [(i, f"t{i}") for i in range(500)], "doc_id long, text string").repartition(4)
    out = sharding.shard_documents(df).collect()
    assert collections.Counter(r.shard for r in out).most_common()[0][1] in (143, 144) and len(out) == 2300
    assert sorted(r.slot for r in out if r.shard == 3) == list(range(sum(r.shard == 3 for r in out)))
    spread = sharding.spread(df.select("doc_id", F.xxhash64("doc_id", "text").alias("__h")))
    assert spread.select("__h").distinct().count() == 2300


def test_payload_columns_are_those_of_sql(spark, docs):
    import duckdb

    from tidegate.llm import queries

    folder = "/root/testdata/sf0.001"
    got = sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) for r in queries.op8_transport_streams(spark, folder).collect())
    want = duckdb.sql(f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM '{folder}/documents.parquet'),
        p AS (SELECT *, greatest(192, CAST(ceil(n / 192) * 192 AS BIGINT)) AS m FROM d)
        SELECT doc_id, n, m, sha256(t || repeat(' ', CAST(m - n AS INTEGER))) FROM p ORDER BY ALL""").fetchall()
    assert got == [tuple(r) for r in want]
