"""The corpus operators against brute force, round trips and edge rows."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fenceline.llm import language, lines, nbest, near_dup, packing, quality, queries, search, secrets, token_output, toxicity
from fenceline.llm.common import vocabulary

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, label string, n_lines int, set_key string, rank string, k int"
KEY = "AKIA" + "QWERTYUIOP123456"
TEXTS = [
    None, "", "   \n\t", "one", "a b c d e", "a b c d e", "Bericht über die Straße und  mehr", "x" * 70_000, "word " * 9000, f"password = hunter2hunter2 and {KEY}",
    "the quick brown fox jumps over the lazy dog again and again until the night comes down on us all today", "The quick brown fox jumps over the lazy dog again and again until the night comes down on us all today",
    "token: " + "ab12" * 16 + "\nshared line of words\nshared line of words", "\U0001f600 emoji ▁ text\r\nwith lines", "0123456789abcdef" * 3,
]


def tricky(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), "x", "y", 1, "z", "r", 5) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id here at all", "en", None, 3, "x", "y", 1, "z", "r", 5), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


OPERATORS = {
    1: lambda d: quality.judged(d), 3: lambda d: nbest.digests(d), 4: lambda d: secrets.scanned(d), 6: lambda d: lines.without_shared_lines(d), 7: lambda d: packing.packed_documents(d),
    9: lambda d: language.identified(d, language.train(d)), 10: lambda d: near_dup.near_duplicates(d),
    8: lambda d: toxicity.scored(d, toxicity.train(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))),
}


@pytest.mark.parametrize("n", sorted(OPERATORS))
def test_edge_rows_keep_one_row_each(spark, n):
    rows = tricky(spark)
    found = OPERATORS[n](rows).select("doc_id").collect()
    want = [r["doc_id"] for r in rows.select("doc_id").collect()]
    if n == 7:  # long texts have several pieces
        assert {r[0] for r in found} == set(want)
    else:
        assert sorted(map(str, (r[0] for r in found))) == sorted(map(str, want))


@pytest.mark.parametrize("n", sorted(OPERATORS))
def test_empty_table(spark, n):
    assert OPERATORS[n](tricky(spark).where("false")).count() == 0


def test_oracles(spark):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, SF)
        want = con.execute(sql)
        columns = sorted(c[0] for c in want.description)
        place = [[c[0] for c in want.description].index(c) for c in columns]
        rows = sorted(tuple(str(r[i]) for i in place) for r in want.fetchall())
        assert sorted(tuple(str(v) for v in r) for r in got.select(*columns).collect()) == rows, name


def test_rule_order_never_changes_the_verdict(docs):
    one = {r["doc_id"]: r["kept"] for r in quality.judged(docs).collect()}
    other = {r["doc_id"]: r["kept"] for r in quality.judged(docs, rules=quality.RULES[::-1], sample_rows=5).collect()}
    assert one == other
    assert {r["doc_id"] for r in quality.good(docs).collect()} == {k for k, v in one.items() if v}


def encoded(path, texts, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)  # the library's own, not the operator's
    return [np.array([*tok.encode(t, add_special_tokens=False).ids, end], "<u4") for t in texts]


def test_token_files(spark, docs, plain):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op2_token_output"](spark, SF).collect()}
    start = 0
    for i, ids in zip(sorted(plain), encoded(vocabulary("byte_bpe_50k.json"), [plain[i] for i in sorted(plain)], 0), strict=True):
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)


def test_token_files_of_edge_rows(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    token_output.write_tokens(tricky(spark), path)
    got = sorted(tuple(r["ids"]) for r in token_output.read_tokens(spark, path).collect())
    texts = [r["text"] or "" for r in tricky(spark).collect()]
    assert got == sorted(tuple(x.tolist()) for x in encoded(vocabulary("byte_bpe_50k.json"), texts, 0))
    assert token_output.token_index(token_output.read_tokens(spark, path)).count() == len(texts)


def scanned_rows(df):
    """Rows that the scan of a collected plan gave."""
    plan = df._jdf.queryExecution().executedPlan()
    nodes, scans = [plan], []
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan"):
            scans.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return sum(scans)


def test_token_files_are_pruned_and_split(spark, tmp_path):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i)))) for i in range(6))).alias("text"))
    path = f"file://{tmp_path}/t"
    token_output.write_tokens(docs, path, files=1, stripe_bytes=200_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = token_output.read_tokens(spark, path).where("doc_id = 4321")
        one.collect()
        none = token_output.read_tokens(spark, path).where("doc_id = 9999")
        none.collect()
        assert 0 < scanned_rows(one) <= 2 * token_output.STRIDE and scanned_rows(none) == 0
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        parts = token_output.read_tokens(spark, path).select("doc_id", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"), F.min("doc_id"), F.max("doc_id")).collect()
        assert len(parts) > 1 and sum(r["n"] for r in parts) == 6000  # a stripe a task, none read twice
    finally:
        for k in ("spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(k)


@pytest.mark.parametrize("empty", [False, True])
def test_search_and_token_files_of_edge_rows(spark, tmp_path, empty):
    docs = tricky(spark).where("false") if empty else tricky(spark)
    found = search.top_k(docs, F.col("id") % 2 == 0, k=3).collect()
    texts = {i: t for i, t in enumerate(TEXTS) if t and t.split()}
    assert {r["query_id"] for r in found} == (set() if empty else {i for i in texts if i % 2 == 0})
    assert all(r["rank"] <= 3 and r["score"] > 0 for r in found)
    if empty:
        token_output.write_tokens(docs, f"file://{tmp_path}/e")
        assert token_output.token_index(token_output.read_tokens(spark, f"file://{tmp_path}/e")).count() == 0


def test_nbest_is_brute_force():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    pieces, sp = nbest.Pieces.of(path), sentencepiece.SentencePieceProcessor(model_file=path)
    names = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}

    def ways(s):
        if not s:
            return [(0.0, ())]
        out = []
        for k in range(1, 17):
            w = s[:k]
            if len(w) == k and (w in names or k == 1):
                score = sp.get_score(names[w]) if w in names else pieces.unknown
                ids = (names[w],) if w in names else tuple(int(pieces.byte_ids[b]) for b in w.encode())
                out += [(score + a, ids + b) for a, b in ways(s[k:])]
        return out

    rng = random.Random(5)
    for _ in range(60):
        s = "▁" + "".join(rng.choice("thereinoa  \nሴ\U0001f600ß1.") for _ in range(rng.randint(1, 9))).replace(" ", "▁")
        every = dict((ids, score) for score, ids in ways(s))
        got = next(iter(nbest.segment(pieces, nbest.codes_of(s), np.array([0, len(s)]), 5)))
        assert [g[0] for g in got] == sorted(every.values(), reverse=True)[:5]
        assert all(every[tuple(ids.tolist())] == score for score, ids in got)
        assert len({tuple(ids.tolist()) for _, ids in got}) == len(got)


def test_encoding_comes_back(spark, docs, plain):
    ways = nbest.encoded(docs.limit(40), n=3)
    back = nbest.decoded(ways.select("doc_id", F.explode("segmentations").alias("s")).select("doc_id", "s.ids")).collect()
    assert back and all(r["text"] == plain[r["doc_id"]].replace("▁", " ") for r in back)
    assert all(r["round_trip"] for r in nbest.digests(docs).collect())


def test_secret_base_spans(docs, plain):
    for r in secrets.scanned(docs).collect():
        text = plain[r["doc_id"]]
        want = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found = [tuple(s) for s in r["spans"]]
        assert sorted(s for s in found if s[0] in ("hex", "access")) == sorted(want)
    assert secrets.find_spans(f"x {KEY}")[0] == ("access", 2, 22)
    assert secrets.redact("a password=abcdefgh1 b", secrets.find_spans("a password=abcdefgh1 b")) == "a [assign] b"


def brute_spans(text):
    """The base spans by a plain walk, and the candidates by a look at every run of token characters."""
    base = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    for kind, first, rest, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), ("hex", "", "0123456789abcdef", 32)):
        i = 0
        while i < len(text):
            j = i + len(first)
            while text.startswith(first, i) and j < len(text) and text[j] in rest:
                j += 1
            if text.startswith(first, i) and j > i + len(first):
                if j - i >= least:
                    base.append((kind, i, j))
                i = j
            else:
                i += 1
    base.sort(key=lambda x: (x[1], secrets.KINDS.index(x[0])))
    ends = [i + len(w) for w in secrets.SENSITIVE for i in range(len(text)) if text[i : i + len(w)].lower() == w]
    found, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-":
            j += 1
        if j - i >= 20:
            inside = sorted(e for e in ends if i < e <= j)
            if any(0 <= i - e <= secrets.REACH for e in ends):
                found.append((i, j))
            elif inside and j - inside[0] >= 20:
                found.append((inside[0], j))
        i = max(j, i + 1)
    return base, found


def test_secret_spans_are_brute_force(docs, plain):
    rng = random.Random(9)
    parts = ["password", "secret", ": ", " = ", '"', "token", "API_KEY", "apikey=", "AKIA", "QWERTYUIOP123456", "0123456789abcdef", "zZ9kQw3LmN8pRt5vYb2c", " ", "\n", "Private ", "é", "x" * 25, "word ", "=", "."]
    texts = [*plain.values(), *("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(300))]
    for text in texts:
        base, near = brute_spans(text)
        got = secrets.find_spans(text)
        assert [x for x in got if x[0] != "novel"] == base
        clear = [(s, e) for s, e in near if not any(a < e and s < b for _, a, b in base)]
        want = [(s, e) for s, e in clear if re.search("[A-Za-z]", text[s:e]) and re.search("[0-9]", text[s:e]) and secrets.marginal(text[max(0, s - 256) : s], text[s:e]) >= secrets.NOVELTY]
        assert [(s, e) for k, s, e in got if k == "novel"] == want
    for r in queries.QUERIES["op4_secret_scan"](docs.sparkSession, SF).collect():
        base, _ = brute_spans(plain[r["doc_id"]])
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in base) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def test_secret_scan_is_linear():
    took = []
    for n in (20_000, 160_000):
        began = time.perf_counter()
        assert secrets.find_spans("token " * n) == [] and secrets.find_spans("tokens" * n) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 1


def test_search_is_brute_force(docs, plain):
    words = {i: defaultdict(int) for i in plain}
    for i, t in plain.items():
        for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)):
            words[i][w] += 1
    words = {i: w for i, w in words.items() if w}
    size = {i: sum(w.values()) for i, w in words.items()}
    n, mean, df = len(words), sum(size.values()) / len(words), defaultdict(int)
    for w in words.values():
        for x in w:
            df[x] += 1
    for postings in (10_000_000, 9_000):
        got = defaultdict(list)
        for r in search.top_k(docs, F.col("id") % 50 == 0, shard_postings=postings, block_terms=500).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["doc_id"], r["score"]))
        for q in (i for i in words if i % 50 == 0):
            every = []
            for i, w in words.items():
                s = sum(np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w[x] * 2.2 / (w[x] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for x in words[q] if x in w)
                if s > 0:
                    every.append((-round(s, 6), i))
            want = [(i, -s) for s, i in sorted(every)[:10]]
            assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=3e-6)
            assert {i for i, s in want if s > want[-1][1] + 1e-5} <= {i for i, _ in got[q]}


def test_bounds_leave_documents_out():
    rng = np.random.default_rng(0)
    sizes = rng.integers(5, 40, 3000)
    lists = [np.unique(np.floor(400 * rng.random(n) ** 3).astype(np.int64)) for n in sizes]
    sizes = np.array(list(map(len, lists)))
    terms, tf = np.concatenate(lists), rng.integers(1, 4, sizes.sum())
    lengths = np.add.reduceat(tf, np.cumsum(sizes) - sizes)
    shard = search.Shard(lengths, terms, tf, sizes, float(lengths.mean()))
    df = np.bincount(terms, minlength=400)
    idf = search._idf(3000, df)
    at, fewest = np.concatenate(([0], np.cumsum(sizes))), 3000
    for q in range(0, 3000, 100):
        asked = lists[q]
        rows, scores, scored = shard.search(asked, idf[asked], 10)
        weight = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * np.repeat(lengths, sizes) / lengths.mean()))
        every = np.round(np.add.reduceat(np.where(np.isin(terms, asked), idf[terms] * weight, 0), at[:-1]), 6)
        floor = np.sort(every)[-10]
        want = {i: every[i] for i in np.flatnonzero((every >= floor) & (every > 0))}
        assert set(rows.tolist()) == set(want) and scores == pytest.approx([want[i] for i in rows.tolist()], abs=2e-6)
        fewest = min(fewest, scored)
    assert fewest < 300
    assert shard.search(np.array([10**9]), np.ones(1), 3)[0].size == 0
    assert search.Shard(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 1.0).search(terms[:1], np.ones(1), 3)[2] == 0


@pytest.mark.parametrize("table", ["documents", "edge"])
def test_packing(spark, docs, plain, table):
    rows = packing.packed_documents(docs if table == "documents" else tricky(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), keep_ids=False).collect()
    texts = plain if table == "documents" else {i: t or "" for i, t in enumerate(TEXTS)}
    ids = dict(zip(texts, encoded(vocabulary("word_bpe_49k.json"), list(texts.values()), 2), strict=True))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(part), zlib.crc32(part), len(ids[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in pieces.items():
        assert sum(n for _, n in own) == len(ids[i])
    assert set(pieces) == set(texts)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
    if table == "documents":
        total = sum(map(len, ids.values()))
        assert 1 - total / (4096 * len(sequences)) < 0.03


def test_knapsack_and_patterns():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        capacity, values = int(rng.integers(n, 40)), rng.normal(0.5, 0.6, n)
        best = [0.0]
        for c in range(1, capacity + 1):
            best.append(max([best[-1], *(best[c - k - 1] + values[k] for k in range(min(n, c)))]))
        worth, counts = packing.best_pattern(values, capacity)
        assert worth == pytest.approx(best[-1]) and worth == pytest.approx((counts * values).sum()) and (counts * np.arange(1, n + 1)).sum() <= capacity
    for _ in range(5):
        demand = rng.integers(0, 40, 24)
        plan, left = packing.solve_patterns(demand)
        plan += [(np.bincount(list(c), list(c.values()), 24), 1) for c in packing.first_fit([(k + 1, k, int(left[k])) for k in np.flatnonzero(left).tolist()], 24)]
        assert all((c * np.arange(1, 25)).sum() <= 24 for c, _ in plan)
        assert (sum(c * n for c, n in plan) >= demand).all()
        assert sum(n for _, n in plan) <= 1.1 * -(-int((demand * np.arange(1, 25)).sum()) // 24) + 3


def test_short_texts_are_packed_by_exact_length(spark):
    for text, size, n in (("the cat", 3, 5000), (None, 1, 5000), ("the cat and", 4, 1025)):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(text).cast("string").alias("text"))
        rows = packing.packed_documents(docs, keep_ids=False)
        assert rows.select("length").distinct().collect() == [(size,)]
        assert rows.select("sequence_id").distinct().count() == -(-n // (4096 // size))


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components(sets):
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    keys = sorted(sets)
    for a, i in enumerate(keys):
        for j in keys[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    p, q = sorted((find(i), find(j)))
                    top[q] = p
    return {i: find(i) for i in keys}


def test_near_duplicates(docs, plain):
    sets = {i: shingle_set(t) for i, t in plain.items()}
    want = components(sets)
    for r in near_dup.near_duplicates(docs).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_near_duplicates_chain_in_one_bucket(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(60):
        own = list(words)
        for k in rng.sample(range(400), rng.choice((0, 4, 9, 14))):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    want = components({i: shingle_set(t) for i, t in rows})
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_deduplicated_keeps_one_of_each_group(spark, docs):
    kept = {r["doc_id"] for r in near_dup.near_duplicates(docs).where("kept").collect()}
    assert sorted(r["doc_id"] for r in near_dup.deduplicated(docs).collect()) == sorted(kept)
    edge = near_dup.deduplicated(tricky(spark))
    assert edge.where("doc_id IN (4, 5)").count() == 1 and edge.columns == tricky(spark).columns


def words_with(changed, size=200):
    return " ".join(f"x{k}" if k in changed else f"w{k}" for k in range(size))


def test_near_duplicates_through_null_ids(spark):
    a, n, b = words_with(range(4)), words_with(()), words_with(range(196, 200))
    far = [words_with(range(i, 200, 3)).replace("w", f"far{i}") for i in range(2)]
    rows = [(1, a), (None, n), (2, b), (None, n), (None, far[0]), (None, far[0] + " tail"), (None, far[1]), (None, far[1]), (None, ""), (None, None)]
    rows += [(1, a)]
    schema = "doc_id long, text string"
    got = near_dup.near_duplicates(spark.createDataFrame(rows, schema), percent=95, bands=64, rows=2).collect()
    apart = near_dup.near_duplicates(spark.createDataFrame([rows[0], rows[2]], schema), percent=95, bands=64, rows=2).collect()
    assert {r["component_id"] for r in apart} == {1, 2}  # A and B are linked by the row without an id only
    linked = [r for r in got if r["component_id"] is not None]
    assert {r["component_id"] for r in linked} == {1} and len(linked) == 5
    assert [r["doc_id"] for r in linked if r["kept"]] == [1]
    assert sum(r["kept"] for r in got if r["n_shingles"] == 0) == 2
    assert sum(r["kept"] for r in got if r["component_id"] is None and r["n_shingles"]) == 2  # one a group


def test_deduplicated_with_repeated_and_null_ids(spark):
    one, near, other = words_with(()), words_with((0,)), words_with(()).replace("w", "v")
    third, fourth = words_with(()).replace("w", "u"), words_with(()).replace("w", "t")
    rows = [(7, one), (7, near), (3, other), (7, other + " tail"), (None, third), (None, third + " tail"), (None, fourth), (9, fourth + " tail")]
    got = near_dup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"].split()[1][0]) for r in got) == [("3", "v"), ("7", "w"), ("9", "t"), ("None", "u")]


def test_language_held_out_accuracy(spark):
    where = SF.replace("0.001", "0.01")
    known = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "lang", F.length("text").alias("size"))
    rows = queries.QUERIES["op9_language_id"](spark, where).join(known, "doc_id").where("held_out AND size > 100").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def sentences(letters, seed, size):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(size))


def test_language_learns_behind_a_shared_header(spark):
    header = sentences("abcdefg", 0, 1200)
    assert len(header) > language.CHUNK
    rows = [(i, header + " " + sentences("qrstuvw" if i % 2 else "hijklmn", i, 3000), "zz" if i % 2 else "bb") for i in range(80)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found, _ = model.scores([sentences("qrstuvw", 1000, 300), sentences("hijklmn", 1001, 300)])
    assert found == ["zz", "bb"]


def test_language_sample_has_one_row_an_id_and_skips_letterless_texts(spark):
    rows = [(i, sentences("abcdefg", i, 50), "aa") for i in range(40)] + [(1, sentences("abcdefg", i, 50), "aa") for i in range(100, 400)] + [(1, sentences("qrstuvw", 1, 50), "zz")]
    rows += [(i, None if i % 2 else " 12 _ \n", "zz") for i in range(500, 900)] + [(i, sentences("qrstuvw", i, 50), "zz") for i in range(900, 920)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = defaultdict(list)
    for r in language.training_rows(docs, per_language=10).collect():
        got[r["lang"]].append(r["text"])
    assert {k: len(v) for k, v in got.items()} == {"aa": 10, "zz": 10} and all(got["zz"])
    assert language.training_rows(docs, per_language=1000).where("id = 1").count() == 2
    assert language.train(docs, per_language=10).scores([sentences("qrstuvw", 2000, 50)])[0] == ["zz"]


def test_toxicity_held_out(spark):  # smaller tables have too few toxic labels to learn from
    where = SF.replace("0.001", "0.1")
    rows = queries.QUERIES["op8_toxicity"](spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    good = [r["score"] for r in rows if not r["toxic"]]
    bad = [r["score"] for r in rows if r["toxic"]]
    above = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert above >= 0.95 * len(bad) * len(good)


def test_toxicity_gradients():
    rng = np.random.default_rng(4)
    net = toxicity.Network(np.arange(1, 9, dtype=np.uint64), rng.normal(size=8).astype(np.float32))
    for k in net.w:
        net.w[k] = (rng.normal(size=net.w[k].shape) * 0.4).astype(np.float32)
    x = rng.normal(size=(7, toxicity.WORD_DIM + toxicity.CHAR_DIM)).astype(np.float32)
    x[-1] = 0
    index = rng.integers(0, 6, (5, 10)).astype(np.int32)
    index[1, 6:] = index[4, 1:] = 6  # windows that end in padding
    slope = rng.normal(size=5).astype(np.float32)
    value = lambda: float(slope @ net.forward(net.gates(x), index, 6).astype(float))
    _, kept = net.forward(net.gates(x), index, 6, keep=True)
    grad, dgates = net.backward(kept, index, slope, len(x))
    grad["in"], grad["bias"] = x.T @ dgates, dgates.sum(axis=0)
    for k, g in grad.items():
        way = rng.normal(size=g.shape).astype(np.float32)
        was, step = net.w[k], 2e-3
        net.w[k] = was + step * way
        up = value()
        net.w[k] = was - step * way
        slope_seen = (up - value()) / (2 * step)
        net.w[k] = was
        assert slope_seen == pytest.approx(float((g * way).sum()), rel=0.02, abs=0.01), k


def test_toxicity_bounds_are_named():
    assert toxicity.FIRST_WINDOWS == 12_288 and "FIRST_WINDOWS" in toxicity.__doc__


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        assert after.count() <= docs.count()
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert not any(secrets.base_spans(r["text"] or "") for r in docs.collect())
    sets = {r["doc_id"]: shingle_set(r["text"] or "") for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    ids = dict(zip([r["doc_id"] for r in docs.collect()], encoded(vocabulary("word_bpe_49k.json"), [r["text"] or "" for r in docs.collect()], 2), strict=True))
    assert {r["doc_id"] for r in got} == set(sets) == set(ids)
    pieces, fill = defaultdict(int), defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(part), zlib.crc32(part), len(ids[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        pieces[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(pieces[i] == len(x) for i, x in ids.items())
    for own in fill.values():
        ends = [sum(n for _, n in sorted(own)[:i]) for i in range(len(own) + 1)]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 4096
    edge = tricky(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in edge.collect()}
        edge = stage(spark, edge, SF)
        assert {r["doc_id"] for r in edge.collect()} <= before, name
    packed = corpus_pipeline.STAGES[-1][1](spark, edge, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in edge.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, edge.where("false"), SF).count() == 0
