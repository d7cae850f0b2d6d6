"""Each operator against a plain version on a small fixture: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from folio.llm import bit_packing, context_tree, fuse_dedup, latent_leaks, license_rules, line_dedup, packing, severity, simhash, tokens, url_templates

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_lines string, digest string, fp string, bucket string"
WS = r"[\x20\x09-\x0D]+"
LONG = "The quick brown fox jumps over the lazy dog again and again. "
LINE = "this very line is repeated in documents"


def texts():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    base = " ".join(rng.choice(words, 120))
    near = base.split()
    near[60] = "changed"
    out = {
        0: None, 1: "", 2: " \t\n ", 3: base, 4: base, 5: " ".join(near), 6: base.upper(), 7: LONG * 800,
        8: f"{LINE}\nown line number eight is long enough\nx", 9: f"  {LINE.upper()}\t\n", 10: f"a\n{LINE}\n\nb\n{LINE}", 11: "mit  License\nGNU General\tPublic License, v3", 12: "  a  b ", 13: " a b ",
        14: "naïve Ünï çödé 漢字  x<|endoftext|>y's we'll", 15: "one two three",
    }
    return out | {20 + k: " ".join(rng.choice(words, 60)) for k in range(15)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, v, "clash", "clash", "clash", "clash") for k, v in texts().items()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def reference_ids(end):
    t = Tokenizer.from_file(PATH)
    return {k: np.array([*t.encode(v or "", add_special_tokens=False).ids, end], "<u4") for k, v in texts().items()}


def test_pieces_are_the_tokenizers_ids():
    odd = ["", " ", "\n", "  a  b\n\n c\t d ", "a \n b", "it's we'll x<|endoftext|> y\x1c z", "a b  c", "\r\n a\r\nb", "word,word. ́x"]
    own, t = tokens.PieceEncoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(odd)] == [t.encode(x, add_special_tokens=False).ids for x in odd]


def test_op4_files_hold_the_ids(docs, none):
    ids, at = reference_ids(2), 0
    got = {r.doc_id: r for r in bit_packing.op4_bit_packed_ids(docs, PATH).collect()}
    for k in sorted(ids):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids[k]), zlib.crc32(ids[k].tobytes()))
        at += len(ids[k])
    assert bit_packing.op4_bit_packed_ids(none, PATH).count() == 0


def test_op4_many_files_and_null_id(spark):
    rows = spark.createDataFrame([(None, "n"), *[(k, f"text {k}") for k in range(50)], (7, "again")], "doc_id long, text string")
    from folio.session import new_folder, written

    folder = new_folder(spark, "test-ids")
    got = bit_packing.read_files(written(bit_packing.write_files(rows, folder, PATH, 2, file_chars=100), "m"), folder).orderBy("start").collect()
    assert got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted([*range(50), 7])
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31, 32])
def test_bit_fields_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 10_001).astype(np.uint32)
    file = bit_packing.PackedFile(bit_packing.build_file(np.arange(3), np.array([1, 0, 10_000]), ids, width))
    file.check()
    assert (file.ids(0, 10_001) == ids).all() and (file.ids(4090, 20) == ids[4090:4110]).all() and file.ids(5, 0).size == 0


def test_op8_every_id_lies_in_one_piece(docs, none):
    ids = reference_ids(0)
    got = packing.op8_differencing_windows(docs, PATH).toPandas()
    for k, rows in got.sort_values("start").groupby("doc_id"):
        assert rows["start"].tolist() == np.cumsum([0, *rows["length"][:-1]]).tolist() and rows["length"].sum() == len(ids[k]) == rows["doc_tokens"].iloc[0]
        assert all(zlib.crc32(ids[k][a : a + n].tobytes()) == c for a, n, c in zip(rows["start"], rows["length"], rows["ids_crc32"], strict=True))
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == np.cumsum([0, *rows["length"][:-1]]).tolist() and rows["length"].sum() <= 1024
    assert packing.op8_differencing_windows(none, PATH).count() == 0


def test_differencing_is_balanced_and_rises_over_capacity():
    sizes = np.random.default_rng(1).integers(1, 256, 900)
    windows = packing.pack_group(sizes, 1024)
    assert sorted(x for w in windows for x in w) == list(range(900)) and max(sizes[w].sum() for w in windows) <= 1024
    assert sizes.sum() / 1024 / len(windows) > 0.97
    assert len(packing.pack_group(np.array([600, 600, 600]), 1024)) == 3


def test_op3_groups_equal_texts(docs, none):
    norm = {k: re.sub(WS, " ", v or "") for k, v in texts().items()}
    groups = {}
    for k, v in norm.items():
        groups.setdefault(v, []).append(k)
    want = {(k, min(groups[v]), len(groups[v]), k == min(groups[v]), hashlib.sha256(v.encode()).hexdigest()) for k, v in norm.items()}
    assert {tuple(r) for r in fuse_dedup.op3_fuse_dedup(docs).collect()} == want
    assert fuse_dedup.op3_fuse_dedup(none).count() == 0


def test_op3_byte_check_splits_equal_digests(docs):
    from pyspark.sql import functions as F

    weak = fuse_dedup.exact_dedup(docs, F.col("doc_id") % 2 == 0, lambda t: F.unhex(F.rpad(F.lpad(F.hex(F.length(t) % 3), 8, "0"), 64, "0")))
    key = lambda r: (r.doc_id, r.keep_id, r.group_size, r.kept)
    assert sorted(map(key, weak.collect())) == sorted(map(key, fuse_dedup.op3_fuse_dedup(docs).collect()))


def test_fuse_filter_has_no_false_negative():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 1000, 50_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        built = fuse_dedup.FuseFilter.build(keys)
        assert built.has(keys).all() and built.has(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.01


def brute_fingerprint(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    root = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= radius and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_op5_components(docs, none):
    fps = {k: brute_fingerprint(v, 4) for k, v in texts().items()}
    want = brute_components(fps, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_pivot_simhash(docs).collect()}
    assert got == {k: (f"{fps[k]:016x}", want[k]) for k in fps}
    assert simhash.op5_pivot_simhash(none).count() == 0


def test_hot_keys_lose_no_link(spark):
    rng = np.random.default_rng(3)
    seed, fps = 0x0123456789ABCDEF, set()
    while len(fps) < 150:
        fps.add(seed ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)))
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 100)}
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = brute_components(dict(enumerate(sorted(fps))) and {x: x for x in fps}, 4)
    for hot in (7, 100_000):
        parent = {x: x for x in fps}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in simhash.near_links(rows, 4, hot=hot).collect():
            a, b = r.a % (1 << 64), r.b % (1 << 64)
            assert (a ^ b).bit_count() <= 4
            parent[max(find(a), find(b))] = min(find(a), find(b))
        assert len({find(x) for x in fps}) == len(set(want.values()))


def test_near_copies_keep_one(spark, docs, none):
    kept = simhash.keep_one(docs)
    got = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and 3 in got and not got & {4, 5, 6} and {7, 8, *range(20, 35)} <= got
    assert simhash.keep_one(none).count() == 0
    twice = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (None, "other words only")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.keep_one(twice).collect()) == ["1", "None"]


def test_op6_lines(docs, none):
    lines = {k: (v or "").split("\n") for k, v in texts().items()}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for k, own in lines.items():
        for x in own:
            holders.setdefault(key(x), set()).add(k)
    gone = lambda k, x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and k < max(holders[key(x)])
    want = {(k, len(own), sum(gone(k, x) for x in own), hashlib.sha256("\n".join(x for x in own if not gone(k, x)).encode()).hexdigest()) for k, own in lines.items()}
    assert {tuple(r) for r in line_dedup.op6_line_dedup(docs).collect()} == want
    assert line_dedup.op6_line_dedup(none).count() == 0


def test_op7_rules_and_template(spark):
    urls = [None, "", "no scheme", "http://A.Example.org/es/1?x", "https://example.org/en/12#t", "http://x.org", "http://x.org/", "http://b.com/de/2", "http://b.com/fr/2", "http://b.com/de", "http://b.com/it/9", "ftp://net/a//b/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.op7_url_templates(rows).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, got[0][3])
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5][2] is None and got[6][2:] == ("org/", "allow") and got[7][2:] == ("com/de/", "block") and got[8][2:] == ("com/fr/", "allow") and got[9][2] is None
    assert got[11][:2] == ("net", "/a//b/") and {v for *_, v in got.values()} <= {"allow", "block"}
    assert url_templates.op7_url_templates(rows.limit(0)).count() == 0


def test_op10_base_counts(docs, none):
    def brute(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        at = {(k, label) for phrase, label in license_rules.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()}
        return len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))

    got = {r.doc_id: r for r in license_rules.op10_license_rules(docs).collect()}
    for k, v in texts().items():
        assert tuple(got[k])[1:6] == brute(v)
        assert set(got[k].base_labels.split(",")) <= set(got[k].labels.split(",")) and 0 <= got[k].score <= 1
    assert license_rules.op10_license_rules(none).count() == 0


def test_op10_contained_detection_is_suppressed():
    got = license_rules.scan("This work is licensed under the GNU General Public License, version 3.")
    assert got["labels"] == "gpl,gpl-3" and got["spans"] == [(3, 12, "gpl-3")] and len(license_rules.rules()) > 200


def test_op2_matches_a_recursion_and_the_base(docs, none):
    depth = 3
    own = {k: (v or "") for k, v in texts().items()}
    train = {k: v for k, v in own.items() if zlib.crc32(str(k).encode()) % 10}
    count = {}
    for v in train.values():
        s = bytes([255]) * depth + v.encode() + b"\xff"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for b in range(8):
                    count.setdefault((s[i - d : i][::-1], (1 << b) | (s[i] >> (8 - b))), [0, 0])[s[i] >> (7 - b) & 1] += 1
    kids = {}
    for c, n in count:
        if c:
            kids.setdefault((c[:-1], n), []).append(c)
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    known = {}
    for c, n in sorted(count, key=lambda x: -len(x[0])):
        k = kt(*count[c, n])
        known[c, n] = k if len(c) == depth else np.logaddexp(k, sum(known[x, n] for x in kids[c, n])) - math.log(2)

    def zero(context, n, d=0):
        z, o = count.get((context[:d], n), (None, None))
        if z is None:
            return 0.5
        if d == depth:
            return (z + 0.5) / (z + o + 1)
        share = math.exp(kt(z, o) - math.log(2) - known[context[:d], n])
        return share * (z + 0.5) / (z + o + 1) + (1 - share) * zero(context, n, d + 1)

    def score(t):
        s, out = bytes([255]) * depth + t.encode() + b"\xff", 0.0
        for i in range(depth, len(s)):
            for b in range(8):
                p = zero(s[i - depth : i][::-1], (1 << b) | (s[i] >> (8 - b)))
                out += math.log10(1 - p if s[i] >> (7 - b) & 1 else p)
        return out

    split = {k: [*lower(v).encode().split(), None] for k, v in own.items()}
    c = Counter(x for k in train for x in split[k])
    n, vocabulary = c.total(), len(c)
    got = {r.doc_id: r for r in context_tree.score_documents(docs, depth).collect()}
    for k in own:
        r = got[k]
        assert r.held_out == (k not in train) and r.train_tokens == n and r.n_tokens == len(split[k]) and r.n_known == sum(c[x] > 0 for x in split[k])
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (vocabulary + 1))) for x in split[k]), rel=1e-9)
        if len(own[k]) < 800:
            assert r.score == pytest.approx(score(own[k]), rel=1e-5)
    assert context_tree.op2_context_tree(none).count() == 0


def test_op2_beats_the_base_on_held_out_text(spark):
    got = context_tree.op2_context_tree(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def test_op1_grades(spark, docs, none):
    labels = spark.createDataFrame([(3, 1, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert severity.op1_ordinal_severity(docs, labels).count() == len(texts())
    assert {r.expected_severity for r in severity.op1_ordinal_severity(docs, labels.limit(0)).collect()} == {0.0}
    assert severity.op1_ordinal_severity(none, labels).count() == 0 and severity.reject_toxic(none, labels).columns == none.columns
    assert severity.reject_toxic(docs, labels.limit(0)).count() == len(texts())


def test_op1_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    own, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = severity.op1_ordinal_severity(own, labels.where("doc_id % 4 <> 0")).join(labels.where("doc_id % 4 = 0").withColumnRenamed("toxic", "y"), "doc_id").toPandas()
    hit = ((got.y == 1) & got.toxic).sum()
    assert hit / got.toxic.sum() > 0.95 and hit / (got.y == 1).sum() > 0.85 and (got.expected_severity >= got.p_toxic).all()


def test_op9_finds_passages_and_paraphrases(spark, none):
    sf = "/root/testdata/sf0.01"
    own, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    bench = {r.item_id: latent_leaks.words_of(r.text) for r in items.collect()}
    true = {(r.doc_id, i) for r in own.collect() for i, w in bench.items() if b" " + b" ".join(w) + b" " in b" " + b" ".join(latent_leaks.words_of(r.text)) + b" "}
    host = own.where("lang = 'en' AND n_chars > 900").orderBy("doc_id").first().text.split()
    w = items.orderBy("item_id").first().text.split()
    altered = " ".join([*host[:70], *(x for k, x in enumerate(w) if k % 9 != 4), *host[70:140]])
    more = own.select("doc_id", "text").union(spark.createDataFrame([(10**6, altered), (10**6 + 1, None), (10**6 + 2, " ".join(host))], "doc_id long, text string"))
    found = latent_leaks.leaks(more, items).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(true & got) >= 0.95 * len(true) and (10**6, 0) in got and not any(d > 10**6 for d, _ in got)
    assert latent_leaks.leaks(none, items).count() == 0 and latent_leaks.leaks(own.limit(20), items.limit(0)).count() == 0
    assert latent_leaks.decontaminate(none, items).columns == none.columns


def test_longest_common():
    assert latent_leaks.longest_common([b"a", b"b", b"c", b"d"], [b"x", b"a", b"c", b"y", b"d"])[0] == 3


def test_word_features_do_not_depend_on_what_is_around():
    from folio.llm import latent_leaks as L

    texts = ["Hello wörld  foo,bar", "", "  ", None, "a" * 50 + " b Hello", "x", "hello FOO"]
    ((first, run),) = L.runs(texts)
    words = [w for x in texts for w in L.words_of(x)]
    assert first == 0
    assert run.lengths.tolist() == [len(L.words_of(x)) for x in texts]
    assert run.flat.tolist() == [int(L.numbered([w])[0]) for w in words]
    assert list(L.runs([])) == []


def test_near_copies_are_decided_by_the_exact_similarity(spark):
    rng = np.random.default_rng(8)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    own, at = {}, 0
    for n in (14, 24, 54, 104, 254):
        # Words changed in the middle: similarities on both sides of 0.8, 50 pairs or so a length.
        for k in range(60):
            w = [f"w{x}" for x in rng.integers(0, 5000, n)]
            other = list(w)
            for j in rng.choice(n, max(1, round(n * (0.01 + 0.035 * (k % 3) / 2))), replace=False):
                other[j] = f"c{k}x{j}"
            if k % 5 == 0:
                other = [*w, *[f"e{k}x{j}" for j in range(max(1, n // 6 + k % 4 - 2))]]
            own[at], own[at + 1] = w, other
            at += 2
    similar = lambda a, b: len(a & b) / len(a | b)
    sets = {k: shingles(w) for k, w in own.items()}
    want = {k: k % 2 == 0 or similar(sets[k - 1], sets[k]) < 0.8 for k in own}
    assert 60 < sum(not x for x in want.values()) < 240
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in own.items()], "doc_id long, text string")
    for hot in (simhash.HOT, 3):
        got = {r.doc_id: r.doc_id == r.component_id for r in simhash.near_copies(docs, hot=hot).collect()}
        assert [k for k in own if got[k] != want[k]] == []


def test_op9_common_passages_long_texts_and_tiny_tables(spark):
    rng = np.random.default_rng(4)
    words = lambda n, of: [f"w{x}" for x in rng.integers(0, of, n)]
    item = [f"p{k}" for k in range(30)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")

    def found(texts):
        return {r.doc_id for r in latent_leaks.leaks(spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string"), bench).collect()}

    host = words(80, 3000)
    copies = [[*host[:40], *item, *host[40:], f"own{k}"] for k in range(20)]
    hosts = [[*words(40, 3000), *item, *words(40, 3000)] for _ in range(20)]
    plain = [words(100, 3000) for _ in range(40)]
    assert found([*copies, *plain[:20]]) == set(range(20)) and found([*hosts, *plain[:20]]) == set(range(20))
    assert found([*[copies[0]] * 20, *plain, hosts[0]]) == {*range(20), 60}
    assert found([hosts[0]]) == {0} and found([plain[0], hosts[0]]) == {1} and found([plain[0]]) == set()
    long = [[f"v{x}" for x in rng.choice(40_000, 12_000, replace=False)] for _ in range(6)]
    assert found([*long[:5], [*long[5][:5000], *item, *long[5][5000:]]]) == {5}


def test_op9_finds_short_items_before_their_own_rare_words():
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    rows = [(k, " ".join([f"r{k}", f"s{k}", *words(8)])) for k in range(30)]
    texts = []
    for _, item in rows:
        own = item.split()
        # The item at the start of a block, and after it its rarest words time and again.
        texts.append(" ".join([*words(40), *own, *words(10), *[own[j % 2] for j in range(40)], *words(40)]))
    weights = latent_leaks.idf(np.bincount(np.concatenate([np.unique(latent_leaks.numbered(latent_leaks.words_of(t))) for t in texts]), minlength=latent_leaks.SIZE), len(texts))
    table = latent_leaks.weighted(latent_leaks.basis_of(latent_leaks.image_of(texts, weights, 64)), weights)
    got = {(at, item) for at, (item, *_) in latent_leaks.search(texts, latent_leaks.Items(rows, table), table)}
    assert got >= {(k, k) for k in range(30)}


def test_op7_branches_beyond_the_third_segment(spark):
    rules = (("h.com", "/a/b/c/bad/x", "block"), ("h.com", "/a/b/c/good/x", "allow"), ("h.com", "/a/b/c/d/e/f/bad/x", "block"), ("h.com", "/a/b/c/d/e/f/good/x", "allow"))
    paths = [f"/a/b/c/{more}{what}/x{k}" for more in ("", "d/e/f/") for what in ("bad", "good") for k in range(30)]
    asked = [f"/a/b/c/{more}{what}/z" for more in ("", "d/e/f/") for what in ("bad", "good")] + ["/a/b/c", "/a/b/c/", "/q/" + "r/" * 300]
    rows = spark.createDataFrame([(k, f"http://h.com{p}") for k, p in enumerate([*asked, *paths])], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.template) for r in url_templates.url_verdicts(rows, rules).collect()}
    assert len(got) == len(asked) + len(paths)
    assert [got[k][0] for k in range(4)] == ["block", "allow", "block", "allow"]
    assert got[0][1] != got[1][1] and got[2][1] != got[3][1] and got[4][1] == got[5][1] == "h.com/*/*/*"


def test_op8_short_documents_fill_their_windows(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'one two three four' AS text")
    got = packing.op8_differencing_windows(docs, PATH).toPandas()
    assert len(got) == 4000 and got["length"].sum() / 1024 / got["sequence_id"].nunique() > 0.9


def test_op10_keywords_are_in_every_match_of_their_rules():
    import re as _re
    import warnings

    from hypothesis import strategies as st
    from hypothesis.errors import NonInteractiveExampleWarning

    warnings.simplefilter("ignore", NonInteractiveExampleWarning)
    letters = st.characters(codec="ascii", categories=["Ll", "Nd", "Zs"])
    for rule in license_rules.rules():
        body = rule.pattern.pattern.removeprefix("(?<![^ ])").removesuffix("(?![^ ])")
        found = st.from_regex(_re.compile(body, _re.A), fullmatch=True, alphabet=letters).example()
        assert rule.keyword in found and any(x.decode() in found for x in license_rules.STEMS), (rule.label, rule.keyword, found)
    assert len({r.keyword for r in license_rules.rules()}) > 300


def test_op10_labels_are_those_of_a_plain_scan():
    """Every rule tried on every text, and each detection held against all that were taken before it."""
    pieces = ["Licensed under the Apache License, Version 2.0.", "the MIT License", "GNU General Public License v3", "All rights reserved.", "Copyright (c) 2019-2021 A", "released under the MIT license", "CC BY-SA 4.0", "font", "without warranty of any kind", "SPDX-License-Identifier: BSD 3 clause", "you can redistribute it and/or modify it under the terms of the GNU General Public License", "word", "3-clause BSD license", "creative commons attribution"]
    rng = np.random.default_rng(3)
    for n in range(60):
        text = " ".join(pieces[k] for k in rng.integers(0, len(pieces), 1 + n % 9))
        words = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)))
        found = sorted((r.priority, m.start() - m.end(), m.start(), at, m.end(), r) for at, r in enumerate(license_rules.rules()) for m in r.pattern.finditer(words))
        taken = []
        for _, _, a, _, b, r in found:
            if not any(x <= a and b <= y for x, y, _ in taken):
                taken.append((a, b, r))
        got = license_rules.scan(text)
        base = {label for phrase, label in license_rules.BASE if f" {phrase} " in f" {words} "}
        assert got["labels"] == ",".join(sorted(base | {r.label for _, _, r in taken}))
        assert got["spans"] == [(words.count(" ", 0, a), words.count(" ", 0, b) + 1, r.label) for a, b, r in taken]
        assert got["score"] == max([0.7 if base else 0.0, *(r.score for *_, r in taken)])
    assert license_rules.scan("You can redistribute it and/or modify it under the terms of the GNU General Public License")["score"] == 1.0


def test_op6_hot_lines_and_clashing_columns(spark):
    rows = [(k, f"{LINE}\nown {k} line that is long enough\n{LINE if k % 2 else ''}", 99, "x", k) for k in range(40)] + [(None, LINE, 99, "y", 0), (7, LINE, 99, "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, row string, doc int")
    keyed = line_dedup.keyed_lines(docs.selectExpr("coalesce(doc_id, -9223372036854775808) AS doc", "text", "xxhash64(text) AS digest"), 20)
    from folio.session import written

    lines = written(keyed, "test-lines")
    pick = lambda n: sorted((r.doc, r.digest, r.dropped) for r in line_dedup.dropped_places(lines, 3, n).collect())
    assert pick(5) == pick(10**6) and len(pick(5)) == 41
    out = line_dedup.drop_lines(docs, counts=False)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == 42 and all(r.n_lines == 99 for r in got) and sorted(r.row for r in got if r.text == "") == ["y", "z"]
    assert [r.text for r in got if r.doc_id == 39] == [rows[39][1]]


def test_keep_one_leaves_clashing_columns_alone(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(30)), "a", "b", "c"), (2, " ".join(f"w{k}" for k in range(30)), "d", "e", "f"), (None, "other words", "g", "h", "i"), (3, None, "j", "k", "l"), (3, None, "m", "n", "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, id string, row string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    found = sorted(tuple(r)[2:] for r in got.collect())
    assert found[:2] == [("a", "b", "c"), ("g", "h", "i")] and len(found) == 3


def test_a_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from folio import session

    conf = SimpleNamespace(get=lambda *_: None)
    java = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, _jsc=java))
    with pytest.raises(RuntimeError):
        session.shared_dir(cluster)


def test_op4_a_hot_id_is_split_over_tasks(spark):
    from folio.session import new_folder, written

    rows = spark.createDataFrame([(7, f"text number {k}") for k in range(400)] + [(3, "first")], "doc_id long, text string").repartition(4)
    folder = new_folder(spark, "test-hot")
    manifest = written(bit_packing.write_files(rows, folder, PATH, 2, file_chars=600, file_ids=40), "m")
    assert manifest.select("part").distinct().count() > 4 and manifest.agg({"docs": "max"}).first()[0] < 100
    got = bit_packing.read_files(manifest, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [3] + [7] * 400 and [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()


def test_op2_folds_case(spark):
    rows = spark.createDataFrame([(k, "Some Words Of Text") for k in range(20)] + [(21, "some words of text")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in context_tree.op2_context_tree(rows).collect()}
    assert len({round(x, 9) for x in got.values()}) == 1


def test_op9_candidates_by_cosine_or_by_a_shared_run():
    """Words that weigh little among rare ones: the cosine is small, a run of the item's words brings it."""
    rng = np.random.default_rng(2)
    common = [f"c{k}" for k in range(12)]
    item = [common[k] for k in rng.integers(0, 12, 10)]
    texts = [" ".join([*(f"r{at}x{k}" for k in range(40)), *(item if at < 5 else rng.permutation(common)[:10]), *(f"s{at}x{k}" for k in range(40))]) for at in range(60)]
    weights = latent_leaks.idf(np.bincount(np.concatenate([np.unique(latent_leaks.numbered(latent_leaks.words_of(t))) for t in texts]), minlength=latent_leaks.SIZE), len(texts))
    table = latent_leaks.weighted(latent_leaks.basis_of(latent_leaks.image_of(texts, weights, 64)), weights)
    found = list(latent_leaks.search(texts, latent_leaks.Items([(0, " ".join(item))], table), table))
    assert {at for at, _ in found} >= set(range(5))


def paraphrased(rng, words, share):
    """A fifth of the words or so replaced, dropped or doubled, the answer left alone but for one."""
    out = list(words)
    for at in sorted(rng.choice(len(words), max(1, round(share * len(words))), replace=False), reverse=True):
        if (kind := rng.integers(0, 3)) == 0:
            out[at] = f"new{rng.integers(0, 10**6)}"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, out[at])
    return out


def test_op9_recall_of_paraphrases():
    """All places that the plain rule calls leaks, found through the candidates."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.zipf(1.3, n) % 3000]
    rows = [(k, " ".join(words(int(rng.integers(8, 60))))) for k in range(80)]
    texts = []
    for k in range(240):
        own = latent_leaks.words_of(rows[k % 80][1])
        texts.append(" ".join(str(x) for x in [*words(50), *[w.decode() if isinstance(w, bytes) else w for w in paraphrased(rng, own, 0.05 + 0.15 * (k % 3) / 2)], *words(50)]))
    weights = latent_leaks.idf(np.bincount(np.concatenate([np.unique(latent_leaks.numbered(latent_leaks.words_of(t))) for t in texts]), minlength=latent_leaks.SIZE), len(texts))
    table = latent_leaks.weighted(latent_leaks.basis_of(latent_leaks.image_of(texts, weights, 64)), weights)
    items = latent_leaks.Items(rows, table)
    got = {(at, item) for at, (item, *_) in latent_leaks.search(texts, items, table)}
    want = {(at, k % 80) for at in range(240) for k in [at] if items.verify(at % 80, latent_leaks.words_of(texts[at]), 0, 10**6)}
    assert len(want) > 150 and len(want & got) >= 0.99 * len(want)


def test_op9_basis_is_fitted_on_every_document(spark):
    from folio.llm import latent_leaks as L

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.2, int(rng.integers(1, 60))) % 4000) for _ in range(6000)] + ["same " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    ((sent, _),) = L._prepared(docs, spark.createDataFrame([(1, texts[0])], "item_id long, text string"))
    weights = L.idf(np.bincount(np.concatenate([np.unique(L.numbered(L.words_of(t))) for t in texts]), minlength=L.SIZE), len(texts))
    # The passages one by one.
    test, image = np.random.default_rng(7).standard_normal((L.SIZE, L.RANK)) * weights[:, None], np.zeros((L.SIZE, L.RANK))
    for text in texts:
        flat = L.numbered(L.words_of(text))
        for at in range(0, len(flat), L.BLOCK):
            own, n = np.unique(flat[at : at + 2 * L.BLOCK], return_counts=True)
            image[own] += np.outer(n * weights[own], n @ test[own])
    want = L.weighted(L.basis_of(image), weights)
    for got in (sent.value, L.weighted(L.basis_of(L.image_of(texts, weights, L.RANK)), weights)):
        a, b = got[:400] @ got[:400].T, want[:400] @ want[:400].T
        assert np.abs(a - b).max() < 0.01 * np.abs(b).max()


def test_op1_is_fitted_on_every_labelled_row(spark):
    """At the model, the plain mean log loss over all rows with its decay has no slope."""
    rng = np.random.default_rng(12)
    size = 9000
    toxic = rng.random(size) < 0.3
    worse = toxic & (rng.random(size) < 0.4)
    words = [[f"{'bad' if t and rng.random() < 0.4 else 'word'}{'abcdefghij'[x]}" for x in rng.integers(0, 10, 12)] for t in toxic]
    texts = [" ".join([*w, *(["worse"] if v and rng.random() < 0.5 else [])]) for w, v in zip(words, worse, strict=True)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(t), int(not v)) for k, (t, v) in enumerate(zip(toxic, worse, strict=True))], "doc_id long, toxic int, quality int")
    model = severity.fit(docs, labels)
    place, feature, value = severity.features(texts)
    own, column = np.unique(feature, return_inverse=True)
    x = np.zeros((size, len(own)))
    x[place, column] = value
    grades = toxic * 1 + worse * 1

    def loss(weights, thresholds):
        above = [np.ones(size), *(1 / (1 + np.exp(t - x @ weights)) for t in thresholds), np.zeros(size)]
        p = np.choose(grades, [a - b for a, b in zip(above[:-1], above[1:], strict=True)])
        return -np.log(p).mean() + severity.DECAY / 2 * (weights**2).sum()

    w, t = model.weights[own].astype(float), np.array(model.thresholds)
    h = 1e-4
    slopes = [(loss(w + h * e, t) - loss(w - h * e, t)) / (2 * h) for e in np.eye(len(own))] + [(loss(w, t + h * e) - loss(w, t - h * e)) / (2 * h) for e in np.eye(2)]
    assert np.linalg.norm(slopes) < 1e-3
    # The cut-off has nearly the F1 of the best one.
    p = 1 / (1 + np.exp(t[0] - x @ w))
    f1 = lambda c: 2 * (toxic & (p >= c)).sum() / ((p >= c).sum() + toxic.sum())
    assert f1(model.cut) > max(map(f1, np.linspace(0.02, 0.98, 49))) - 0.01


def test_op1_features_survive_their_packing(spark):
    rng = np.random.default_rng(5)
    texts = ["", None, "a", "one", "zebra " * 700 + "äöüßéè naïve wörterbuch", " 12 ", "x" * 300, *(" ".join(f"{'abcdefgh'[x % 8]}{'klmnop'[x % 6]}{'qrstu' * (x % 3)}" for x in rng.integers(0, 200, n)) for n in (1, 3, 50, 4000))]
    sizes, gaps, counts, large = severity.encoded(texts)
    rows = spark.createDataFrame([(k % 3, k % 2 == 0, int(n), *map(bytes, x)) for k, (n, *x) in enumerate(zip(sizes, gaps, counts, large, strict=True))], "grade int, kept boolean, words long, gaps binary, counts binary, large binary").coalesce(1)
    ((got,),) = [list(severity.rows_of(b)) for b in severity.packed(rows).toArrow().combine_chunks().to_batches()]
    place, feature, value = severity.features(texts)
    real = got.value > 0
    assert got.grades.tolist() == [k % 3 for k in range(len(texts))] and got.kept.tolist() == [k % 2 == 0 for k in range(len(texts))]
    assert np.repeat(np.arange(len(texts)), got.many)[real].tolist() == place.tolist() and got.feature[real].tolist() == feature.tolist()
    assert np.allclose(got.value[real], value) and max(map(len, large)) > 0 and not real.all()
    weights = rng.standard_normal(severity.SIZE)
    assert np.allclose(got.margin(weights), np.bincount(place, weights[feature] * value, minlength=len(texts)))
    # Words and their first 4, 5 and 6 characters, not bytes: a word of three letters has one feature, one of seven four.
    own = lambda *x: [severity.features([t])[1].tolist() for t in x]
    a, b, c = own("wör", "wörterx", "wörterbuch")
    assert (len(a), len(b), len(c)) == (1, 4, 4) and len(set(b) & set(c)) == 3
    assert own("Foo foo, bar") == own("bar-FOO") and severity.features(["foo foo bar"])[2].tolist() != severity.features(["foo bar bar"])[2].tolist()


def test_op1_fit_moves_no_texts(spark):
    """Labels too many to broadcast: what the fit shuffles doesn't follow the texts, of which most have no label."""
    rng = np.random.default_rng(2)
    context = spark.sparkContext._jsc.sc()

    def moved():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).head().totalShuffleWrite()

    docs = spark.createDataFrame([(k, f"{'bad' if k % 3 == 0 else 'good'} word " + rng.bytes(4000).hex().translate({ord(x): "0" for x in "abcdef"})) for k in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 1) for k in range(0, 1000, 2)], "doc_id long, toxic int, quality int")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = moved()
        model = severity.fit(docs, labels)
        shuffled = moved() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert shuffled < 400_000
    got = severity.grade_documents(docs.where("doc_id < 60"), model).collect()
    assert all((r.p_toxic >= model.cut) == (r.doc_id % 3 == 0) for r in got)


def test_op1_filter_drops_no_labelled_document(spark):
    ids = spark.range(0, 60_000, 3).selectExpr("id * 7919 - 5 AS doc_id")
    words = severity.filter_of(ids)
    passed = lambda rows: severity.passed(words, rows.selectExpr("xxhash64(doc_id) AS h").toArrow()["h"].combine_chunks().to_numpy().view(np.uint64))
    assert passed(ids).all() and passed(spark.range(10**12, 10**12 + 20_000).selectExpr("id AS doc_id")).mean() < 0.1


def test_op1_memory_of_a_run_of_texts_is_small():
    import tracemalloc

    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abcdefghijklmnop", np.uint8)
    texts = [b" ".join(letters[rng.integers(0, 16, 7)].tobytes() for _ in range(2000)).decode() for _ in range(400)]
    tracemalloc.start()
    for part in severity._runs(texts):
        severity.features(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6


def test_op9_compares_only_stretches_that_may_hold_the_item(monkeypatch):
    from folio.llm import latent_leaks as L

    rng = np.random.default_rng(13)
    words = lambda n: [b"w%d" % x for x in rng.zipf(1.3, n) % 900]
    rows = [(k, b" ".join(words(int(rng.integers(9, 50)))).decode()) for k in range(30)]
    items = L.Items(rows, rng.standard_normal((L.SIZE + 1, 4)).astype(np.float32))
    real, calls, plain = L.longest_common, [], 0
    monkeypatch.setattr(L, "longest_common", lambda a, b: calls.append(1) or real(a, b))
    found = 0
    for k in range(30):
        item = items.words[k]
        text = [*words(90), *paraphrased(rng, item, 0.02 * (k % 8)), *words(90)]
        # Every stretch compared, the first best one taken.
        reach, starts = len(item) + max(4, len(item) // 3), range(0, len(text) - len(item) + 1, max(1, len(item) // 8))
        best = max(((*real(item, text[s : s + reach]), -s) for s in starts), key=lambda x: (x[0], x[3]))
        plain += len(starts)
        got = items.verify(k, text, 0, len(text))
        if got:
            found += 1
            assert got == (best[0] / len(item), best[1] - best[3], best[2] - best[3])
    assert found > 15 and len(calls) < plain / 2


def test_op9_sums_of_strips():
    rng = np.random.default_rng(14)
    table, heads = rng.integers(0, 99, (50, 3)), np.array([0, 1, 4, 20, 21, 700, 702])
    rows = rng.integers(0, 50, 703)
    assert (latent_leaks.sums_of_strips(table, rows, heads) == np.add.reduceat(table[rows], heads, axis=0)).all()
    assert latent_leaks.sums_of_strips(table, rows[:0], heads[:0]).shape == (0, 3)
