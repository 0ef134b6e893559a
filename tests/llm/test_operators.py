"""Each operator against its contract in plain Python."""

from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, embeddings, graph, language, minhash, mixture, pu, queries, quality, rows, secret_scan, substrings, token_ids, toxicity, words

key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)


def same(found, expected):
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("which", ["odd", "small", "empty"])
def test_token_files(spark, request, which, odd_rows, small_rows):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    given = {"odd": pairs(odd_rows), "small": small_rows, "empty": []}[which]
    path = queries.tokenizer_path()
    same(token_ids.token_files(docs, path).collect(), brute.tokens(given, Tokenizer.from_file(path)))


@pytest.mark.parametrize("which", ["odd", "small", "empty"])
def test_repeated_passages(request, which, odd_rows, small_rows):
    docs = request.getfixturevalue(which)
    given = {"odd": pairs(odd_rows), "small": small_rows, "empty": []}[which]
    for size in (13, 4, 30):
        found = substrings.without_repeats(docs, size).cache()
        digests = found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
        same(digests, brute.repeats(given, size))
        for r in found.collect():
            assert sum(s.end - s.start for s in r.spans) == r.n_removed


@pytest.mark.parametrize("which", ["odd", "small", "empty"])
def test_near_duplicates(request, which, odd_rows, small_rows):
    docs = request.getfixturevalue(which)
    given = {"odd": pairs(odd_rows), "small": small_rows, "empty": []}[which]
    for size in (2, 5):
        same(minhash.near_duplicates(docs, size).collect(), brute.near(given, size))


def test_one_of_each_group_stays(odd, odd_rows):
    kept = minhash.one_of_each(odd, 2)
    assert kept.columns == odd.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, minhash.one_of_each(odd.repartition(2), 2).collect()))
    ids = [r.doc_id for r in kept.collect()]
    expected = {r[0] for r in brute.near(pairs(odd_rows), 2) if r[3] and r[0] is not None}
    assert sorted(i for i in ids if i is not None) == sorted(expected)
    assert sum(i is None for i in ids) == 2


def test_large_groups_keep_every_link(spark):
    """A chain whose ends are far apart, copies, and near copies of one text."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        rows.append((1000 - i, " ".join(base[:i] + [f"x{j}" for j in range(60 - i)][:0] + [f"c{j}" if j < i else base[j] for j in range(i, 60)])))
    chain = list(base)
    for i in range(0, 60, 3):
        chain = [*chain[:i], f"d{i}", *chain[i + 1 :]]
        rows.append((2000 + i, " ".join(chain)))
    rows += [(3000 + i, " ".join(base)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    same(minhash.near_duplicates(docs, 2).collect(), brute.near(rows, 2))


@pytest.mark.parametrize("which", ["odd", "small", "empty"])
def test_decontamination(spark, request, monkeypatch, which, odd_rows, small_rows):
    docs = request.getfixturevalue(which)
    given = {"odd": pairs(odd_rows), "small": small_rows, "empty": []}[which]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    if which == "odd":
        items = [(1, odd_rows[12][1]), (2, "two words"), (2, "ONE"), (3, ""), (4, None), (None, odd_rows[10][1]), (10, odd_rows[14][1][:3000])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute.contaminated(given, items)
    for limit in (1 << 24, 400):  # one block of items, and many
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit if which == "odd" else max(limit, 4000))
        found, (n, spans, names) = decontaminate.contamination(docs, benchmark)
        digests = found.select(
            "doc_id", n, decontaminate.hit_words(F.col(spans)), F.size(names), F.sha2(F.array_join(names, ",").cast("binary"), 256),
            decontaminate.contaminated(F.col(n), F.col(spans)),
        )
        same(digests.collect(), expected)
    assert decontaminate.clean(docs, benchmark).columns == docs.columns


def test_fm_index_finds_all_phrases():
    import numpy as np

    random = np.random.default_rng(3)
    text = np.append(random.integers(1, 5, 500), 0)
    text[200:300] = text[50:150]
    index = decontaminate.FMIndex(text)
    for size in (1, 2, 5, 13):
        phrases = np.stack([text[i : i + size] for i in range(0, 480, 7)])
        low, high = index.search(phrases, np.full(len(phrases), size))
        for p, a, b in zip(phrases, low, high):
            expected = [i for i in range(501 - size) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == expected


def test_near_vectors(spark):
    import random

    draw = random.Random(2)
    point = lambda: [draw.gauss(0, 1) for _ in range(16)]
    centres = [point() for _ in range(5)]
    rows = []
    for i in range(700):
        centre = centres[i % 5]
        noise = 0.02 if i % 3 else 0.16
        rows.append((i, [c + draw.gauss(0, noise) for c in centre] if i % 4 else point(), i % 2))
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None], 1), (904, [nan] * 16, 1), (905, [inf] + [1.0] * 15, 1)]
    rows += [(906, centres[0], None), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1), (909, [1e200] * 16, 0), (910, [1e-200] * 16, 0), (None, centres[0], 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(5).withColumn("root", F.lit(1))
    found = {r.vec_id: tuple(r) for r in embeddings.near_vectors(frame).collect()}
    expected = {r[0]: r for r in brute.vectors(rows)}
    assert found == expected
    assert embeddings.near_vectors(frame.limit(0)).collect() == []


def test_links_of_a_dense_label(spark, monkeypatch):
    """Planted pairs in one hot topic, many copies of a vector: every link of a full comparison, and nearly every one with small blocks."""
    import numpy as np

    random = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    topic = unit(unit(random.standard_normal(64)) + 0.42 * unit(random.standard_normal((6000, 64))))
    x = np.concatenate([topic, unit(topic[:300] + 0.37 * unit(random.standard_normal((300, 64)))), np.repeat(topic[:1], 900, axis=0)])
    hit = x @ x.T >= 0.93
    np.fill_diagonal(hit, False)
    places = graph.smallest_places(len(x), *np.nonzero(hit))
    expected = sorted((i, int(n), int(r), i == r) for i, (n, r) in enumerate(zip(hit.sum(axis=1), places)))
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int").repartition(5)
    assert (places != np.arange(len(x))).sum() > 1100
    found = sorted(map(tuple, embeddings.near_vectors(frame).collect()))
    assert found == expected
    monkeypatch.setattr(embeddings, "TILE_BYTES", 1 << 17)  # blocks of 256 vectors in every round
    found = sorted(map(tuple, embeddings.near_vectors(frame).collect()))
    assert all(a[1] <= b[1] for a, b in zip(found, expected))  # nothing counted twice
    assert sum(a[1] for a in found) >= 0.99 * sum(b[1] for b in expected)


def test_repeated_vectors_are_one(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert sorted(map(tuple, embeddings.near_vectors(frame).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


@pytest.mark.parametrize("few", [1 << 20, 0, 40])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(301)) and all(found[1000 + i] == 1000 for i in range(200))
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.prototypes(docs.filter(rows.crc_bucket("doc_id", 4) != 2))
    found, (lang, score) = language.predict(docs, model)
    held = found.filter(rows.crc_bucket("doc_id", 4) == 2).agg(F.avg((F.col(lang) == F.col("lang")).cast("int"))).first()[0]
    assert held > 0.97
    assert found.filter(~F.col(score).between(0, 1)).isEmpty()
    found, (lang, score) = language.predict(odd, model)
    assert score == "_score" and found.columns[: len(odd.columns)] == odd.columns
    for r in found.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r[lang] == "und") == (not letters)
    assert language.predict(empty, model)[0].collect() == []
    untrained = language.predict(odd, language.prototypes(empty))[0]
    assert {r[lang] for r in untrained.collect()} == {"und"}


def test_language_profiles_against_plain_ones(spark, odd_rows):
    """Predictions and scores as by vectors that are bound and summed run by run."""
    import unicodedata

    import numpy as np

    def numbers(text):
        out = []
        for c in text:
            counts = c.isalpha() or unicodedata.category(c)[0] == "M"
            out.append(ord(c.lower()) if counts and len(c.lower()) == 1 else ord(c) if counts else 0)
        return [n for i, n in enumerate(out) if n or not i or out[i - 1]]

    def bundle(text):
        n, total = numbers(text), np.zeros(language.DIMENSIONS)
        for a, b, c in zip(n, n[1:], n[2:]):
            if b:
                va, vb, vc = language.letter_vectors(np.array([a, b, c]))
                total += np.roll(va, 2) * np.roll(vb, 1) * vc
        return total

    given = [(t[:400], lang) for _, t, lang, *_ in odd_rows if t] + [("Привет, как дела сегодня", "ru"), ("Καλημέρα σας κόσμε", "el"), ("नमस्ते दुनिया कैसे हो", "hi"), ("你好世界你好", "zh"), (None, "ru"), ("abc", None)]
    model = language.prototypes(spark.createDataFrame(given, "text string, lang string").repartition(3))
    profile = {}
    for text, lang in given:
        if text and lang:
            profile[lang] = profile.get(lang, 0) + bundle(text)
    probe = [t for t, _ in given] + ["как хорошо", "καλη μερα", "दुनिया", "世界你好", "Straße — …", "12 34", "", "é"]
    found = language.predict(spark.createDataFrame([(i, t) for i, t in enumerate(probe)], "i int, text string"), model)[0].collect()
    for r in found:
        x = bundle(r.text or "")
        cosine = {k: float(x @ v / np.linalg.norm(v) / (np.linalg.norm(x) or 1)) for k, v in profile.items()}
        if any(c.isalpha() for c in r.text or ""):
            assert abs(r.score - max(0, max(cosine.values()))) < 1e-4 and cosine[r.lang_pred] > max(cosine.values()) - 1e-4
        else:
            assert (r.lang_pred, r.score) == ("und", 0)
    assert [r.lang_pred for r in found[-8:-4]] == ["ru", "el", "hi", "zh"]


def test_any_number_of_languages(spark, monkeypatch):
    """1101 languages, in one block and in several, give the same answers."""
    import random

    draw = random.Random(8)
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x430, 0x450)]
    texts = [" ".join("".join(draw.choice(letters) for _ in range(6)) for _ in range(8)) for _ in range(1101)]
    docs = spark.createDataFrame([(i, t, f"l{i:04d}") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(4)
    seen = []
    for limit in (language.LANGUAGES, 300):
        monkeypatch.setattr(language, "LANGUAGES", limit)
        model = language.prototypes(docs)
        assert model.languages == 1101 and model.blocks == (1 if limit > 1101 else 8)
        seen.append(sorted(map(tuple, language.predict(docs, model)[0].collect())))
    assert [r[:4] for r in seen[0]] == [r[:4] for r in seen[1]] and all(abs(a[4] - b[4]) < 1e-5 for a, b in zip(*seen))
    assert all(lang == found for _, _, lang, found, _ in seen[0])


@pytest.mark.parametrize("which", ["odd", "small", "empty"])
def test_mixture(request, which):
    docs = request.getfixturevalue(which)
    given = docs.select("doc_id", "text", "source").collect()
    found = mixture.mix(docs).collect()
    assert sorted((r.size for r in found)) == sorted(len(brute.WORD.findall(r.text or "")) for r in given)
    sizes, taken, largest, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    source = {}
    for r in given:
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
        source.setdefault(r.doc_id, r.source)
    expected = brute.targets(sizes) if sizes else {}
    by_size = defaultdict(list)
    for s, t in expected.items():
        by_size[sizes[s]].append(t)
    for r in found:
        assert any(abs(r.target - t) < 1e-6 for t in by_size[r.source_size])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source_size, r.target] += r.taken
        largest[r.source_size, r.target] = max(largest[r.source_size, r.target], r.size)
    for k, n in taken.items():
        assert abs(n - k[1] * sum(1 for x in by_size[k[0]] if abs(x - k[1]) < 1e-6)) <= largest[k] * len(by_size[k[0]])
    again = sorted(map(tuple, mixture.mix(docs.repartition(3)).collect()), key=key)
    assert again == sorted(map(tuple, found), key=key)


def test_equal_rows_are_taken_one_by_one(spark):
    """A source of rows with one id and text, and one of rows without id, meet their targets."""
    rows = [(7, "five words in this text", "a")] * 90 + [(None, "four words are here", "b")] * 60 + [(i, "one more", "c") for i in range(200)]
    found = mixture.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)).collect()
    assert len(found) == len(rows)
    for size, target in ((5, 1090 / 6), (4, 1090 / 3)):
        mine = [r for r in found if r.size == size]
        assert {round(r.target, 6) for r in mine} == {round(target, 6)}
        assert abs(sum(r.taken for r in mine) - target) <= size / 2


def test_quality_and_toxicity(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = rows.crc_bucket("doc_id", 5) != 0
    for learn, score, label, at, least in ((quality.learn_quality, quality.score_quality, "quality", 0.3, 0.97), (toxicity.learn_toxicity, toxicity.score_toxicity, "toxic", 0.5, 0.95)):
        model = learn(docs, labels, train)
        found, (name,) = score(docs, model)
        held = found.join(labels, "doc_id").filter(~train).select(F.avg(((F.col(name) >= at).cast("int") == F.col(label)).cast("int"))).first()[0]
        assert held > least, (label, held)
        found, (name,) = score(odd, model)
        assert name == "_score" and found.filter(f"{name} IS NULL OR {name} NOT BETWEEN 0 AND 1").isEmpty() and found.count() == odd.count()
        assert score(empty, model)[0].collect() == []
        assert learn(empty, labels.limit(0), train) is None
        assert {r._score for r in score(odd, None)[0].collect()} == {0.5}


def test_marks_tell_windows_of_one_hash_apart():
    """Windows that agree in the 64-bit hash alone are two groups; marks depend on the order of words, not on the place."""
    words_ = np.arange(1, 40, dtype=np.uint64)
    row = np.concatenate([words_, words_[::-1], words_])
    marks = words.window_marks(row, np.array([0, 39, 78]), 13)
    assert marks[0] == marks[2] != marks[1]
    order, firsts = substrings._both(np.zeros(3, np.uint64), marks)
    assert len(firsts) == 2 and sorted(order.tolist()) == [0, 1, 2]
    assert len(substrings._both(np.zeros(0, np.uint64), np.zeros(0, np.uint32))[1]) == 0


def test_prior_and_curve():
    """The prior of a known mixture is found without a negative, and the curve tells the two kinds apart at it."""
    rng = np.random.default_rng(5)
    for prior in (0.1, 0.5, 0.85):
        marks = rng.random(4000) < prior
        p, u = rng.normal(4, 1, 3000), np.where(marks, rng.normal(4, 1, 4000), rng.normal(-2, 1, 4000))
        found = pu.class_prior(p, u)
        assert abs(found - prior) < 0.06
        slope, shift = pu.curve(p, u, found)
        assert ((slope * u + shift >= 0) == marks).mean() > 0.97


@pytest.mark.parametrize("n_p, n_u", [(1, 1), (1, 3), (2, 1), (3, 5)])
def test_few_texts(n_p, n_u):
    """One positive or one unlabelled text is enough for a model; equal texts and empty ones do no harm."""
    def text(number, *tokens):
        return np.array(sorted(tokens), np.uint64), np.ones(len(tokens), np.int64), np.zeros(pu.N_SHAPE), number

    positive = [text(i, *([7] if i else [])) for i in range(n_p)]
    model, prior = pu.learned(positive, [text(n_p + i, 9) for i in range(n_u)], 4, rate=False, use_shape=True, beyond=0.0)
    assert 0 < prior < 1 and np.isfinite([model.slope, model.shift]).all()


@pytest.mark.parametrize("which", ["odd", "small", "empty"])
def test_secrets(request, which):
    docs = request.getfixturevalue(which)
    network = secret_scan.train(*secret_scan.own_findings(request.getfixturevalue("small")))
    found, (name,) = secret_scan.scan(docs, network)
    for r in found.collect():
        mine = [f"{f.kind}:{f.start}:{f.end}" for f in r[name]]
        assert [x for x in mine if not x.startswith("network")] == brute.base_secrets(r.text or "")
        assert all(0 <= f.score <= 1 for f in r[name])


def test_network_adds_unlisted_keys(spark):
    import random

    draw = random.Random(1)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = lambda n: "".join(draw.choice(chars) for _ in range(n))
    rows = [(i, f"some plainwordsthatarelong here token = \"{made(30)}\" and antidisestablishment anotherlongishwording") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    network = secret_scan.train(*secret_scan.own_findings(docs))
    probe = spark.createDataFrame([(1, f"é the key is {made(40)} ok"), (2, "an extraordinarilylongwording here"), (3, "token=abc")], "doc_id bigint, text string")
    found, (name,) = secret_scan.scan(probe, network)
    kinds = {r.doc_id: [(f.kind, f.start, f.end) for f in r[name]] for r in found.collect()}
    assert kinds == {1: [("network", 13, 53)], 2: [], 3: []}


def test_network_judges_whole_candidates(spark):
    """Keys round a base finding and inside long runs are found; ids, paths and versions are not."""
    import random

    draw = random.Random(5)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = lambda n: "".join(draw.choice(chars) for _ in range(n))
    words = ["extraordinarily", "antidisestablishment", "anotherlongishwording", "plainwordsthatarelong", "configuration", "implementation"]
    rows = [(i, f"some {draw.choice(words)} here token = \"{made(30)}\" and {draw.choice(words)} {draw.choice(words)}{draw.choice(words)}") for i in range(400)]
    network = secret_scan.train(*secret_scan.own_findings(spark.createDataFrame(rows, "doc_id bigint, text string")))
    around, inside = f"{made(12)}Z0123456789abcdef9Q{made(12)}", f"{'implementation/' * 4}{made(40)}{'/configuration' * 4}"
    probe = spark.createDataFrame([(1, f"it is {around} ok"), (2, f"at {inside} ok"), (3, "at plainwords_configuration_20241 and implementation/configuration/1234 ok")], "doc_id bigint, text string")
    found, (name,) = secret_scan.scan(probe, network)
    kinds = {r.doc_id: [(f.kind, f.end - f.start) for f in r[name] if f.kind == "network"] for r in found.collect()}
    assert kinds == {1: [("network", len(around))], 2: [("network", len(inside))], 3: []}


def test_threshold_keeps_the_wanted_recall():
    import numpy as np

    views = [secret_scan.view(np.frombuffer(b"abcdefgh12345678", np.uint8), 0, 16, 0, 16)] * 400
    labels = (np.arange(400) // 4 % 4 == 0).astype(np.int64)
    network = secret_scan.train(views, labels)
    assert network.probability(views[:1])[0] < 0.5 and (network.probability(views) >= network.threshold).all()


def test_queries_return_the_contracts_columns(spark):
    columns = {
        "op1": "doc_id start n_tokens ids_crc32", "op2": "doc_id n_words n_removed kept_sha256", "op3": "doc_id n_shingles component_id kept",
        "op4": "doc_id n_words n_hit n_items items_sha256 contaminated", "op5": "vec_id n_links component_id kept", "op6": "doc_id held_out lang_pred score",
        "op7": "doc_id size source_size target taken", "op8": "doc_id held_out score predicted", "op9": "doc_id held_out score predicted",
        "op10": "doc_id n_assign n_access n_hex base_sha256 spans",
    }
    for name, query in queries.QUERIES.items():
        assert query(spark, "/root/testdata/sf0.001").columns == columns[name.split("_")[0]].split()
