"""What the contracts say of added tokens and letters, near duplicates on one template, and plain versions of the two models."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fenceline.llm import language, lines, near_dup, packing, quality, token_output, toxicity
from fenceline.llm.common import slices, vocabulary

from ..conftest import SF
from .test_operators import components, encoded, shingle_set, tricky

END, BEGIN = "<|endoftext|>", "<|startoftext|>"
TOKENS = [
    f"a {END} b", f"a  {END}  b", END, f"{END}{END}", f"x{END}y", f"{BEGIN}the  cat{END}", f"a\n\n{END}\n b", f"end {END}", f"é{END}  x", f"<|endof{END}text|>", "<|endoftext|", "<|ENDOFTEXT|>", "", None, f"{END} the", f" {BEGIN} {END} ",
    "<|endof", "text|> two rows must not make a token", f"word {END} " * 3000,
]


def test_added_tokens_are_taken_as_the_library_takes_them(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TOKENS)), "doc_id long, text string").coalesce(1)
    token_output.write_tokens(docs, f"file://{tmp_path}/t")
    want = encoded(vocabulary("byte_bpe_50k.json"), [t or "" for t in TOKENS], 0)
    assert {r["doc_id"]: r["ids"] for r in token_output.read_tokens(spark, f"file://{tmp_path}/t").collect()} == {i: x.tolist() for i, x in enumerate(want)}
    got = defaultdict(list)
    for r in packing.pieces(docs, keep_ids=True).orderBy("start").collect():
        got[r["id"]] += r["ids"]
    assert got == {i: x.tolist() for i, x in enumerate(encoded(vocabulary("word_bpe_49k.json"), [t or "" for t in TOKENS], 2))}


def test_files_follow_the_size_and_one_id_may_have_several(spark, tmp_path):
    docs = spark.range(4000).select((F.col("id") * 0 + 7).alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
    token_output.write_tokens(docs, f"file://{tmp_path}/t", files=4)
    rows = token_output.read_tokens(spark, f"file://{tmp_path}/t").select("*", F.col("_metadata.file_path").alias("file"))
    assert rows.count() == 4000 and rows.groupBy("file").count().agg(F.max("count")).first()[0] < 3000
    index = token_output.token_index(token_output.read_tokens(spark, f"file://{tmp_path}/t")).orderBy("start").collect()
    at = 0
    for r in index:
        assert r["start"] == at
        at += r["n_tokens"]


def test_numerals_are_no_letters(spark):
    signs = ["½ ²", "③", "Ⅷ 12", "१२", "_ - 9", "😀", None, ""]
    assert [language.has_letter(t) for t in signs if t] == [False] * 6 and language.has_letter("9ª") and language.has_letter("漢")
    rows = [(i, f"{w} mots de la phrase {i}", "fr") for i, w in enumerate("abcdefgh")] + [(100 + i, f"words of the phrase {i}", "en") for i in range(8)] + [(200 + i, t, "zz") for i, t in enumerate(signs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang"] for r in language.training_rows(docs).collect()} == {"fr", "en"}
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identified(docs, language.train(docs)).collect()}
    assert all(found[200 + i] == ("und", 0.0) for i in range(len(signs)))


def templates(n, seed=1):
    """Texts of one template, alike by some 60 %, a few of them near copies of their neighbour."""
    rng = random.Random(seed)
    template = [f"t{k}" for k in range(320)]
    rows = []
    for i in range(n):
        own = list(template)
        for block in range(0, 320, 64):
            own[block : block + 12] = [f"u{i}_{block + k}" for k in range(12)]
        if i % 20 == 1:
            own = list(rows[-1])
            own[rng.randrange(320)] = "changed"
        rows.append(own)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


def test_one_template_makes_few_pairs(spark):
    counts = []
    for n in (100, 400):
        texts = templates(n)
        sets = {i: shingle_set(t) for i, t in texts}
        like = len(sets[2] & sets[3]) / len(sets[2] | sets[3])
        assert 0.55 < like < 0.7
        number = {s: k for k, s in enumerate({s for x in sets.values() for s in x})}
        rows = [(i.to_bytes(4, "big"), len(x), i.to_bytes(4, "big"), sorted(number[s] for s in x)) for i, x in sets.items()]
        mates = {int.from_bytes(r["set_key"], "big") for r in near_dup.prefix_mates(spark.createDataFrame(rows, "set_key binary, n long, label binary, shingles array<long>"), 75).collect()}
        linked = {k for i in sets for j in range(i) if 7 * len(sets[i] & sets[j]) >= 3 * (len(sets[i]) + len(sets[j])) for k in (i, j)}
        assert linked <= mates
        counts.append(len(mates))
        if n == 100:
            got = near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
            assert {r["doc_id"]: r["component_id"] for r in got} == components(sets)
    assert counts == [10, 40]  # the near copies and what they copy, a tenth of all; these are linked before, so nothing is left to pair


def test_prefix_filter_loses_no_pair(spark):
    rng = random.Random(4)
    sets = [set(rng.sample(range(40), rng.randint(1, 30))) for _ in range(60)]
    sets += [{*s, 100 + k} - {rng.choice(sorted(s))} for k, s in enumerate(sets) if len(s) > 1]
    rows = [(i.to_bytes(4, "big"), len(x), i.to_bytes(4, "big"), sorted(x)) for i, x in enumerate(sets)]
    for percent in (50, 75, 90):
        got = {int.from_bytes(r["set_key"], "big"): r["elsewhere"] for r in near_dup.prefix_mates(spark.createDataFrame(rows, "set_key binary, n long, label binary, shingles array<long>"), percent).collect()}
        want = {k for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) for k in (i, j)}
        assert all(e == len(sets[i] & set().union(*sets[:i], *sets[i + 1 :])) for i, e in got.items())
        assert want <= set(got)


def test_recall_at_a_larger_table(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    want = components({r["doc_id"]: shingle_set(r["text"] or "") for r in docs.collect()})
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()} == want


def plain_logit(net, x, window):
    """One window by single steps: both directions' gates, then attention."""
    w, h = {k: v.astype(float) for k, v in net.w.items()}, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    into = w["in"].reshape(-1, 3, 2, h)
    bias = w["bias"].reshape(3, 2, h)
    states = []
    for side, name in enumerate("fb"):
        state, own = np.zeros(h), []
        for word in window if name == "f" else window[::-1]:
            z, r, n = (x[word].astype(float) @ into[:, g, side] + bias[g, side] for g in range(3))
            z, r = sigmoid(z + state @ w[f"{name}z"]), sigmoid(r + state @ w[f"{name}r"])
            new = np.tanh(n + r * (state @ w[f"{name}n"]))
            state = (1 - z) * new + z * state
            own.append(state)
        states.append(own if name == "f" else own[::-1])
    y = np.array([np.concatenate(pair) for pair in zip(*states, strict=True)])
    weight = np.exp(y @ w["attend"])
    return float((weight / weight.sum()) @ y @ w["out"] + w["out0"][0])


def test_toxicity_scores_are_those_of_single_steps():
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(40)] + ["Idiot", "é"]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 5, 31, 32, 33, 47, 48, 49, 200)]
    net = toxicity.fit([*texts * 4], [k % 2 for k in range(len(texts))] * 4)
    part = next(slices(pa.array(texts), limit=1 << 30))
    win = toxicity.Windows(part)
    x = net.inputs(win.keys, win.trigrams, win.tri_first)
    got = net.scores(win)
    logits = net.window_logits(win)
    for k, text in enumerate(texts):
        own = range(win.first[k], win.first[k + 1])
        size = len(text.split())
        assert len(own) == max(1, -(-(size - (toxicity.WINDOW - toxicity.STRIDE)) // toxicity.STRIDE))
        held = [[i for i in win.index[j].tolist() if i != len(win.keys)] for j in own]
        lower = text.lower().split()
        assert [len(h) for h in held] == [len(lower[i * toxicity.STRIDE : i * toxicity.STRIDE + toxicity.WINDOW]) for i in range(len(own))]
        want = [plain_logit(net, x, h) for h in held]
        assert logits[win.first[k] : win.first[k + 1]] == pytest.approx(want, abs=2e-4)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(net.scale * max(want) + net.shift))), abs=2e-4)


def test_language_scores_are_those_of_gram_sets():
    rng = random.Random(6)
    texts = [("".join(rng.choice("abcde ") for _ in range(60)), "a") for _ in range(12)] + [("".join(rng.choice("defgh ") for _ in range(60)), "b") for _ in range(12)]

    def grams(text):
        """The places of the text's n-grams, found one by one."""
        found = set()
        for n in range(1, language.MAX_N + 1):
            for i in range(len(text) - n + 1):
                h = 0
                for k, c in enumerate(text[i : i + n]):
                    h = (h ^ (ord(c) * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA77 & 0xFFFFFFFF
                    h ^= h >> 15
                found.add(((h + n) * 0xC2B2AE3D & 0xFFFFFFFF) >> (32 - language.BITS))
        return found

    kernel = lambda s, t: len(s & t) / np.sqrt(len(s) * len(t))
    sets = [grams(t) for t, _ in texts]
    bits = [np.packbits(language.presence([t]) > 0, axis=1)[0].tobytes() for t, _ in texts]
    model = language.fit(["a", "b"], bits[::2], [(lang, b, 1.0) for (_, lang), b in zip(texts, bits, strict=True)])
    marks = sets[::2]
    k_mm, k_nm = np.array([[kernel(s, t) for t in marks] for s in marks]), np.array([[kernel(s, t) for t in marks] for s in sets])
    values, vectors = np.linalg.eigh(k_mm)
    root = vectors / np.sqrt(values)
    z = k_nm @ root
    y = np.array([[1.0 if lang == x else -1.0 for x in "ab"] for _, lang in texts])
    beta = root @ np.linalg.solve(z.T @ z + language.RIDGE * np.eye(len(marks)), z.T @ y)
    for text in ("abc ade", "hhg fed", "eee dd", "abcde defgh" * 500):
        parts = [text[i : i + language.CHUNK] for i in range(0, len(text), language.CHUNK)]
        mean = sum(len(p) * np.array([kernel(grams(p), m) for m in marks]) @ beta for p in parts) / len(text)
        said, score = model.scores([text])
        assert said == ["ab"[int(mean.argmax())]] and score[0] == pytest.approx(min(1, max(0, (mean.max() + 1) / 2)), abs=1e-3)


def test_pipeline_stages_are_brute_force(spark):
    """Verdicts, cut lines and components of each stage, on what the stage before it left."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(tricky(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id") + 10**6))
    good = stages["quality_rules"](spark, docs, SF)
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judged(docs).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, kept in verdicts.items() if kept}

    texts = {r["doc_id"]: (r["source"], r["text"]) for r in good.collect()}
    sites = defaultdict(set)
    for source, text in texts.values():
        for line in (text or "").split("\n"):
            sites[line].add(source)
    shared = {line for line, found in sites.items() if len(found) >= lines.MIN_SITES and len(line.split()) >= lines.MIN_WORDS}
    good = spark.createDataFrame(good.collect(), good.schema)
    cut = stages["line_dedup"](spark, good, SF)
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert shared and after == {i: None if t is None else "\n".join(x for x in t.split("\n") if x not in shared) for i, (_, t) in texts.items()}

    cut = spark.createDataFrame(cut.collect(), cut.schema)
    want = components({i: shingle_set(t or "") for i, t in after.items()})
    left = {r["doc_id"]: r["text"] for r in stages["near_dedup"](spark, cut, SF).collect()}
    assert left == {i: after[i] for i, top in want.items() if i == top} and len(left) < len(after)
