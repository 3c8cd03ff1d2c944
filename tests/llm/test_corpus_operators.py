"""Corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ctph, feistel, hyperminhash, line_templates, mixing, ri_classifier, rule_ledger, textbytes, token_counts, url_filter, wfst
from tessera.llm.components import components
from tessera.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = WORD.findall(low(text))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


# --- words as bytes -----------------------------------------------------------------------


def test_word_bounds_and_hashes():
    texts = ["", "a", " a  bb\n", None, "\x0b\x0c x y", "é\x85z Q", "q"]
    data, offsets = textbytes.bytes_of(pa.array(texts))
    starts, ends, first = textbytes.word_bounds(data, offsets)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    h = textbytes.word_hashes(data, starts, ends, lower=True)
    by_word = {}
    for w, x in zip(words, h.tolist()):
        assert by_word.setdefault(low(w), x) == x
    assert len(set(by_word.values())) == len(by_word)


# --- 1: SentencePiece ---------------------------------------------------------------------


def test_encoding_is_the_librarys(spark, odd, documents):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    coder = wfst.Transducer(open(path, "rb").read())
    random.seed(4)
    bits = ["th", "e", " ", "  ", "\n", "12", ".", "é", "日", "😀", "▁", "<s>", "ing", " the", "\t", "x" * 50, "<0x41>"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 25))) for _ in range(1500)] + [" " * i + "a" for i in range(40)] + [r[0] for r in documents.select("text").limit(60).collect()]
    for text, want in zip(texts, library.encode(texts)):
        ids = coder.encode(text)
        assert ids.tolist() == want
        assert coder.decode(ids) == library.decode(want)
    found = {(r["doc_id"], r["n_tokens"], r["round_trip"]) for r in wfst.encode(odd, path).collect()}
    assert (3, 0, True) in found and (4, 0, True) in found and all(x[2] for x in found)
    back = {r["doc_id"]: r["text"] for r in wfst.decode(wfst.encode(odd, path), path).collect()}
    assert back[7] == next(t for i, t, *_ in [(r[0], r[1]) for r in odd.collect()] if i == 7)


# --- 2: URLs ------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://a.net/x", "http://example.net/en/1", "HTTPS://WWW.Example.NET/en/?q#f", "http://notexample.net/en/", "http://b.example.com/de/1", "x.org/fr/", None, "", "http://x.org/fr/2", "http://a.net", "http://u.spam-farm.org/1", "http://c.org/?PHPSESSID=1", "http://knet/", "http://xnet/"]
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert got["http://a.net/x"] == ("a.net", "/x", "net/", "block")
    assert got["HTTPS://WWW.Example.NET/en/?q#f"] == ("www.example.net", "/en/", "example.net/en/", "allow")
    assert got["http://notexample.net/en/"][2] == "net/"
    assert got["http://b.example.com/de/1"][2:] == ("example.com/de/", "block")
    assert got[None] == ("", "", None, "allow") and got["x.org/fr/"] == ("", "", None, "allow")
    assert got["http://x.org/fr/2"][2:] == ("org/fr/", "allow")
    assert got["http://a.net"] == ("a.net", "", None, "allow")
    assert got["http://u.spam-farm.org/1"][3] == "block" and got["http://c.org/?PHPSESSID=1"][3] == "block" and got["http://xnet/"][2] is None


def test_index_runs_few_rules_and_misses_none(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url")
    rules = url_filter.SITE_RULES + url_filter.PATTERN_RULES
    for r in url_filter.judge(pages).collect():
        site = [x for x in rules if x.scope == "site" and re.search(x.pattern, r["host"] + r["path"])]
        assert r["rule"] == (max(site, key=lambda x: len(x.name)).name if site else None)
        pattern = [x.name for x in rules if x.scope == "url" and re.search(x.pattern, r["url"].lower())]
        assert (r["pattern"] in pattern) if pattern else r["pattern"] is None
        assert r["n_candidates"] < len(rules)


# --- 3: lines -----------------------------------------------------------------------------


def test_recurring_templates_go(spark):
    boiler = "Copyright {} Example Press all rights reserved here"
    docs = [(i, f"{' '.join(chr(97 + 5 * i + j) * 3 for j in range(5))} end\n{boiler.format(1990 + i)}\nok\nok", i) for i in range(5)]
    docs += [(9, "The user alice opened the front door at noon\nlast", 0), (10, "The user alice opened the front gate at noon", 0), (11, "The user alice opened the front lid at noon", 0), (12, None, 0), (13, "", 0)]
    out = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame(docs, "doc_id long, text string, lines int")).collect()}
    assert out[0]["text"] == docs[0][1] and out[0]["n_dropped"] == 0
    assert all(out[i]["text"] == docs[i][1].replace(boiler.format(1990 + i) + "\n", "") for i in range(1, 5))
    assert out[9]["n_dropped"] == 0 and out[10]["text"] == "" and out[11]["n_dropped"] == 1
    assert out[12]["text"] is None and out[13]["text"] == "" and out[3]["lines"] == 3


def test_lines_that_recur_verbatim(spark, documents):
    """All that is dropped recurs, and of what recurs verbatim only the first document's is left."""
    before = {r["doc_id"]: r["text"] for r in documents.collect()}
    after = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(documents).collect()}
    count: dict[str, set] = {}
    for i, t in before.items():
        for line in t.split("\n"):
            if len(WORD.findall(line)) >= line_templates.MIN_TOKENS:
                count.setdefault(line, set()).add(i)
    for i, t in after.items():
        left = t.split("\n")
        for line in set(before[i].split("\n")):
            holders = count.get(line, set())
            if len(holders) >= line_templates.MIN_DOCS and i != min(holders):
                assert line not in left
            if line not in left and len(holders) == 1:
                assert re.search(r"\d", line) or len(WORD.findall(line)) >= line_templates.SHORTEST


def test_login_rule_is_found_whatever_the_counts():
    """A URL that the rule matches has the token it is filed under: /login.php5 has no token php."""
    rule = [r for r in url_filter.PATTERN_RULES if r.name == "login"]
    url = "https://a.com/login.php5"
    filed = url_filter.build_index(tuple(rule), {"login": 9, "php": 1})
    assert re.search(rule[0].pattern, url) and set(filed) & set(re.split("[^a-z0-9]+", url))


def test_templates_of_a_large_leaf(spark, monkeypatch):
    """All lines of a leaf meet, however many they are: each template keeps its first line alone."""
    monkeypatch.setattr(line_templates, "BLOCK", 64)
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    docs = []
    for t in range(200):
        body = [word() for _ in range(9)]
        docs += [(3 * t + j, " ".join(["the", "same", "start", *body[:4], word(), *body[5:]])) for j in range(3)]
    out = line_templates.drop_recurring(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: r["n_dropped"] for r in out.collect()} == {i: int(i % 3 > 0) for i in range(600)}


def test_templates_of_short_and_long_lines(spark):
    """Lines of any length generalise: 4 and 5 words, and more than 128."""
    long = " ".join(f"{a}{b}" for a in "abcdefghijkl" for b in "abcdefghijklmno")
    docs = [(i, f"{long} {x} end\nwe all saw {x} there\nplease look at {x}\nsee {x} now") for i, x in enumerate(["red", "green", "blue"])]
    out = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {0: docs[0][1], 1: "see green now", 2: "see blue now"}


def test_templates_found_by_segments(monkeypatch):
    """Looking templates up by segments gives those of comparing with each."""
    draw = np.random.default_rng(3)
    for width in (4, 5, 6, 8, 13, 40):
        tokens = draw.integers(0, 3, (40, width), dtype=np.uint16)[draw.integers(0, 40, 500)]
        tokens = np.where(draw.random(tokens.shape) < 0.15, draw.integers(3, 9, tokens.shape), tokens).astype(np.uint16)
        tokens[:, : line_templates.LEADING] = 1
        monkeypatch.setattr(line_templates, "SCANNED", 10**9)
        plain = line_templates.form_templates(tokens)
        monkeypatch.setattr(line_templates, "SCANNED", 0)
        assert (line_templates.form_templates(tokens) == plain).all()


# --- 4: mixing ----------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), (None, 100)]) == {"a": 200.0, "b": pytest.approx(250 * 2 / 3), None: pytest.approx(250 / 3)}
    assert sum(mixing.targets([("a", 10), ("b", 1000), ("c", 5), ("d", 70)]).values()) == pytest.approx(1.5 * 1085)
    assert mixing.targets([]) == {}


def test_mix(spark, documents, odd, none):
    docs = documents.unionByName(odd)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((r["doc_id"] or -1, len(WORD.findall(r["text"] or ""))) for r in docs.collect())
    by = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for name, own in by.items():
        target, size = own[0]["target"], sum(r["size"] for r in own)
        assert own[0]["source_size"] == size
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) / 2 + 1e-6
        # the fractional part is a prefix in the order of the keys
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))
    assert mixing.mix(none).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.count() == sum(r["epochs"] + r["sampled"] for r in rows) and copies.columns == docs.columns


def test_heavier_documents_are_likelier(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), (F.col("id") % 8 < 4).alias("good"))
    weight = F.when(F.col("doc.good"), 3.0).otherwise(1.0)
    found = mixing.mix(docs, weight=weight).join(docs.select("doc_id", "good"), "doc_id").filter("source = 'b'").groupBy("good").agg(F.avg(F.col("sampled").cast("int")).alias("p")).collect()
    p = {r["good"]: r["p"] for r in found}
    assert p[True] > p[False] + 0.1


# --- 5: shards ----------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(n):
    p = feistel.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert feistel.permute(p, n, inverse=True).tolist() == list(range(n))


def test_shards(spark, documents, odd, none):
    rows = feistel.assign_shards(odd.unionByName(documents)).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(slots) == 16 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows) == 209
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in rows[:50]:
        if r["doc_id"] and r["doc_id"] > 7:
            raw = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    again = feistel.assign_shards(odd.unionByName(documents).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert feistel.assign_shards(none).count() == 0


# --- 6: fingerprints ----------------------------------------------------------------------


def test_fingerprints(spark, documents):
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    order = sorted(docs)
    rows = {r["doc_id"]: r for r in ctph.fingerprint_documents(documents).collect()}
    assert sorted(rows) == order
    for a, b in zip(order, order[1:] + order[:1]):
        n = len(docs[a])
        edited = docs[a][: n - n // 2] + docs[b][: n // 2]
        r = rows[a]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert [r["fingerprint"], r["edited_fingerprint"]] == [ctph.fingerprints([t.encode()])[0] for t in (docs[a], edited)]
        assert r["near_next"] == pytest.approx(ctph.compare([(r["fingerprint"], rows[b]["fingerprint"])])[0])
    near, apart = (np.mean([r[c] for r in rows.values()]) for c in ("near_edited", "near_next"))
    assert near > 0.4 and apart < 0.15


def test_fingerprints_of_odd_rows(odd, none):
    rows = ctph.fingerprint_documents(odd).collect()
    assert len(rows) == 9 and ctph.fingerprint_documents(none).count() == 0
    assert [r["fingerprint"] for r in rows if r["doc_id"] in (3, 4)] == ["3::", "3::"]
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}) == 1


def test_likeness_is_an_edit_distance():
    random.seed(1)

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    pairs = [("".join(random.choices("abc", k=random.randint(1, 64))), "".join(random.choices("abc", k=random.randint(1, 64)))) for _ in range(200)]
    for (a, b), x in zip(pairs, ctph._likeness(pairs)):
        run = max(k for k in range(5) if any(a[i : i + k] in b for i in range(len(a) - k + 1)))
        want = 2 * lcs(a, b) / (len(a) + len(b)) if run >= min(4, max(1, min(len(a), len(b)) // 4)) else 0
        assert x == pytest.approx(want)


# --- 7: quality rules ---------------------------------------------------------------------


def measured(text):
    w = WORD.findall(text or "")
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_ledger(spark, documents, odd):
    repeated = "a b c d e f g h i a b c d e f g h j b c d e f g h i\nx\nx y\nx\n|#|"
    docs = documents.unionByName(odd).unionByName(spark.createDataFrame([(77, repeated, "en", "a", 1)], odd.schema))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = rule_ledger.ledger(docs).select("doc_id", *[f"measured.{m}" for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "failed").collect()
    key = lambda r: str(r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((i, *measured(t)) for i, t in texts), key=key)
    for r in got:
        assert bool(r["failed"] & 1) == (r["n_words"] < 20) and bool(r["failed"] & 2) == (100 * r["n_repeat_words"] > 30 * r["n_words"])


def test_ablations(documents):
    l = rule_ledger.ledger(documents).cache()
    rows = [r["failed"] for r in l.select("failed").collect()]
    for r in rule_ledger.ablations(l, "web.v2").collect():
        bit = rule_ledger.BIT[r["rule"]]
        assert (r["failed"], r["failed_alone"]) == (sum(bool(x & bit) for x in rows), sum(x == bit for x in rows))


def test_clean_documents_are_kept(spark, small, documents):
    """No document of good quality fails a rule beyond those of the base policy."""
    good = rule_ledger.ledger(documents).join(spark.read.parquet(f"{small}/labels.parquet").filter("quality = 1"), "doc_id")
    assert good.count() > 50 and good.filter(F.col("failed") > rule_ledger.POLICIES["base.v1"]).count() == 0


# --- 8: classifier ------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    try:
        docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    except Exception:
        pytest.skip("no test tables")
    rows = ri_classifier.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r["predicted"] == 1 for r in rows if r["quality"] == 1]) > 0.95


def test_classifier_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in ri_classifier.classify(odd, labels).collect())
    assert {r["score"] for r in ri_classifier.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert ri_classifier.classify(none, labels).count() == 0


# --- 9: token counts ----------------------------------------------------------------------


def test_token_counts_are_the_librarys(spark, odd, documents):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    counter = token_counts.Tokenizer(open(path, encoding="utf-8").read())
    random.seed(3)
    bits = ["'", "s", "t", "r", "e", "v", "l", "a", "B", "é", "1", "²", " ", "  ", "\n", "\t", "!", "<|endoftext|>", "　", "日", "😀", "\x1c", "x" * 60]
    texts = ["".join(random.choices(bits, k=random.randint(0, 40))) for _ in range(3000)] + [r[0] for r in documents.select("text").limit(60).collect()]
    data, offsets = textbytes.bytes_of(pa.array(texts))
    assert counter.count(data, offsets).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(odd, path).collect())
    assert got == sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())


def test_chunks_compose():
    kinds = np.random.Generator(np.random.PCG64(1)).integers(0, 12, 5000).astype(np.uint8)
    state, want = 0, []
    for k in kinds.tolist():
        want.append(int(token_counts._MARKS[state + k]))
        state = int(token_counts._TO[state + k])
    assert token_counts.marks(kinds).tolist() == want


# --- 10: near duplicates ------------------------------------------------------------------


def brute(texts, n):
    """(id, set size, least id reachable) by comparing all."""
    sets = [(i, shingles(t, n)) for i, t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    lead = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            lead[find(a)] = min(i, lead.get(find(a), i))
    return sorted((str(i), len(s), str(lead.get(find(a), i) if s else i)) for a, (i, s) in enumerate(sets))


def test_near_duplicates(spark, documents, odd):
    random.seed(7)
    rows = [(r["doc_id"], r["text"]) for r in documents.limit(60).collect()]
    body = next(t for _, t in rows if len(t.split()) > 120).split()[:150]
    for i in range(60):
        w = list(body)
        for _ in range(random.randint(0, 9)):
            w[random.randrange(len(w))] = random.choice(["alpha", "beta", "gamma"]) + str(random.randrange(50))
        rows.append((5000 + i, " ".join(w)))
    rows += [(r["doc_id"], r["text"]) for r in odd.collect()] + [(6000, "one two"), (6001, "ONE two"), (6002, "two one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for size in (4, 5):
        got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in hyperminhash.near_duplicates(docs, size=size).collect())
        assert got == brute(rows, size)


def test_near_duplicates_of_nothing(none, clashing):
    assert hyperminhash.near_duplicates(none).count() == 0
    assert hyperminhash.drop_near_duplicates(clashing).columns == clashing.columns


def test_estimates():
    draw = np.random.Generator(np.random.PCG64(5))
    for share in (0.2, 0.8):
        both = draw.integers(0, 1 << 63, int(4000 * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, draw.integers(0, 1 << 63, 2000 - len(both) // 2, dtype=np.uint64)])) * np.uint64(2) + np.uint64(1) for _ in range(2))
        a, b = (np.unique(textbytes.mix(x)) for x in (a, b))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got, used = hyperminhash.estimate(hyperminhash.registers(a)[None], hyperminhash.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
        assert abs(got[0] - true) < 5 * (true * (1 - true) / used[0]) ** 0.5


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    for small in (0, 1000):
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(3), small).collect()}
        assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- all of them on odd tables ------------------------------------------------------------


def test_clashing_columns_and_empty_tables(clashing, none):
    assert rule_ledger.ledger(clashing).count() == 9 and rule_ledger.ledger(none).count() == 0
    assert line_templates.drop_recurring(clashing).count() == 9 and line_templates.drop_recurring(none).count() == 0
    assert mixing.mix(clashing).count() == 9 and mixing.mixed_documents(clashing).columns == clashing.columns
    assert feistel.assign_shards(clashing).count() == 9
    assert wfst.encode(clashing, vocabulary("piece_bpe_32k.model")).count() == 9
    assert token_counts.count_tokens(clashing, vocabulary("byte_bpe_50k.json")).count() == 9
    assert ctph.fingerprint_documents(clashing).count() == 9
