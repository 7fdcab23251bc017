"""Inputs that must neither crash an operator nor lose rows without a word, and queries without SQL against plain versions."""

import gzip
import hashlib
import itertools
import json
import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.llm import chat, decontaminate, jaccard, language, mixing, quality, queries, substrings, tokencount, urlfilter, warc

ROWS = [(1, "a few words of the first text in this table " * 3, "x"), (2, None, None), (3, "", "x"), (None, "no id here", "y"), (4, "a few words of the first text in this table " * 3, "x"), (4, "again", "x"), (4, "again", "x")]
NAMES = ["repetition", "my col", "my-col", "my.col", "row", "h", "doc", "dedup", "copies", "taken", "__h", "n_tokens", "language", "listed", "w0", "lo", "ranges", "size", "t", "class", "node"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return docs.select("*", *[F.lit(i).alias(name) for i, name in enumerate(NAMES)])


def keeps(found, odd, added, replaced=()):
    own = [c for c in odd.columns if c not in replaced]
    assert found.columns == [*own, *added]
    return [tuple(r)[: len(own)] for r in found.collect()]


def all_rows(odd, replaced=()):
    at = [i for i, c in enumerate(odd.columns) if c not in replaced]
    return sorted(([r[i] for i in at] for r in odd.collect()), key=repr)


def same(got, want):
    assert sorted(map(list, got), key=repr) == want


def test_any_column_names_in_every_operator(spark, odd):
    same(keeps(quality.repetition(odd), odd, ["repetition"], ["repetition"]), all_rows(odd, ["repetition"]))
    same(keeps(tokencount.token_counts(odd, queries.vocabulary()), odd, ["n_tokens"], ["n_tokens"]), all_rows(odd, ["n_tokens"]))
    model = language.fit(odd.select("text", F.lit("en").alias("lang")))
    same(keeps(language.identify(odd, model), odd, ["language"], ["language"]), all_rows(odd, ["language"]))
    same(keeps(substrings.remove_repeats(odd), odd, ["dedup"], ["dedup"]), all_rows(odd, ["dedup"]))
    items = spark.createDataFrame([(1, "never there at all")], "item_id long, text string")
    same(keeps(decontaminate.drop_contaminated(odd, items), odd, []), all_rows(odd))
    pages = odd.withColumn("url", F.lit("http://a.org/es/1"))
    urls = spark.createDataFrame([("b",)], "canonical string")
    added = ["host", "path", "canonical", "rule", "listed", "verdict"]
    same(keeps(urlfilter.judge(pages, urls, queries.RULES), pages, added, ["listed"]), all_rows(pages, ["listed"]))
    assert mixing.mix(odd).count() == len(ROWS)
    assert jaccard.classes(odd).count() == len(ROWS)


def test_any_column_names_in_every_stage(spark, odd, sf):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns if name != "mix_sources" else [c for c in odd.columns if c not in ("copies", "taken")] + ["copies", "taken"], name
        out.collect()
        assert stage(spark, odd.limit(0), sf).count() == 0, name


def test_a_split_never_starts_inside_a_payload(spark, tmp_path):
    warc.register(spark)
    rng = random.Random(3)
    inner = b"".join(warc._member(warc._record({"warc_type": "resource", "record_id": f"inner{i}", "payload": rng.randbytes(3000)}), 0) for i in range(12))
    rows = [("resource", f"outer{i}", bytearray(inner + bytes([i]))) for i in range(6)]
    records = spark.createDataFrame(rows, "warc_type string, record_id string, payload binary").coalesce(1)
    path = str(tmp_path / "nested")
    records.write.format("warc").option("level", 0).option("indexbytes", 1).mode("append").save(path)
    for size in (1, 5000, 70_000):
        read = warc.read(spark, path, splitbytes=size)
        assert sorted((r.record_id, bytes(r.payload)) for r in read.collect()) == [(b, bytes(c)) for _, b, c in rows]


def archive(path):
    return next(p for p in Path(path).iterdir() if p.name.endswith(".warc.gz"))


def test_truncated_archives_raise(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "cut")
    rows = [("resource", f"r{i}", bytearray(os.urandom(5000))) for i in range(10)]
    spark.createDataFrame(rows, "warc_type string, record_id string, payload binary").coalesce(1).write.format("warc").mode("append").save(path)
    data = archive(path).read_bytes()
    archive(path).write_bytes(data[:-2500])
    with pytest.raises(Exception, match="truncated record"):
        warc.read(spark, path).collect()
    headers = "warc_type string, record_id string"
    for cut in (1, 2500, 4900):
        archive(path).write_bytes(data[:-cut])
        for found in (warc.read(spark, path, headers), warc.read(spark, path, headers).filter("warc_type = 'metadata'"), warc.read(spark, path).filter("record_id = 'r0'")):
            with pytest.raises(Exception, match="truncated record"):
                found.collect()
    plain = tmp_path / "plain"
    plain.mkdir()
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 4000\r\n\r\n" + b"x" * 4000 + b"\r\n\r\n"
    for name, pack in (("p.warc", bytes), ("p.warc.gz", lambda x: gzip.compress(x))):
        one, two = pack(record), pack(record[::1])
        for cut, whole in ((0, True), (30, False), (len(two) - 20, False)):
            (plain / name).write_bytes((one + two)[: len(one + two) - cut])
            for found in (warc.read(spark, str(plain), "warc_type string"), warc.read(spark, str(plain), "warc_type string").filter("warc_type = 'response'")):
                if whole:
                    assert found.count() in (0, 2)
                else:
                    with pytest.raises(Exception, match="truncated record|no end of a record"):
                        found.collect()
        (plain / name).unlink()
    (plain / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: metadata\r\nX: " + b"x" * (2 << 20) + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    with pytest.raises(Exception, match="no end of a record's header"):
        warc.read(spark, str(plain)).collect()
    (plain / "a.warc").unlink()
    one = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    (plain / "b.warc.gz").write_bytes(gzip.compress(one + one))
    with pytest.raises(Exception, match="more than one record"):
        warc.read(spark, str(plain)).collect()


def test_unwanted_payloads_are_not_inflated(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "bad")
    rows = [("resource" if i % 2 else "metadata", f"r{i}", bytearray(os.urandom(50_000))) for i in range(10)]
    spark.createDataFrame(rows, "warc_type string, record_id string, payload binary").coalesce(1).write.format("warc").mode("append").save(path)
    data, at = bytearray(archive(path).read_bytes()), 0
    for i in range(10):
        size = int.from_bytes(data[at + len(warc.MARK) : at + len(warc.MARK) + 4], "little")
        if i % 2 == 0:
            data[at + 20_000 : at + size - 8] = b"\xff" * (size - 20_008)
        at += size
    archive(path).write_bytes(bytes(data))
    read = warc.read(spark, path)
    heads = warc.read(spark, path, "record_id string, payload_length bigint")
    assert heads.count() == 10 and read.filter("warc_type = 'resource'").count() == 5
    assert sorted(bytes(r.payload) for r in read.filter("warc_type = 'resource'").collect()) == sorted(bytes(c) for a, _, c in rows if a == "resource")
    with pytest.raises(Exception):
        read.select("payload").collect()


def test_filters_of_one_query_do_not_stay_for_the_next(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "two")
    rows = [("resource" if i < 7 else "metadata", f"r{i}", bytearray(b"x")) for i in range(10)]
    spark.createDataFrame(rows, "warc_type string, record_id string, payload binary").write.format("warc").mode("append").save(path)
    read = warc.read(spark, path)
    assert [read.count(), read.filter("warc_type = 'resource'").count(), read.count(), read.filter("record_id = 'r1'").count(), read.count()] == [10, 7, 10, 1, 10]


def test_special_strings_without_a_bracket(tmp_path):
    from tokenizers import Tokenizer

    spec = json.loads(Path(queries.vocabulary()).read_text())
    spec["added_tokens"][0]["content"] = "[INST]"
    spec["model"]["vocab"]["[INST]"] = spec["model"]["vocab"].pop("<|endoftext|>", 50256)
    path = tmp_path / "inst.json"
    path.write_text(json.dumps(spec))
    texts = ["hi [INST] there", "[INST]", "<|endoftext|>", "a[INST][INST]b", ""]
    want = [len(e.ids) for e in Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]
    assert tokencount.Counter(str(path)).count(texts).tolist() == want
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="pre-tokenizer"):
        tokencount.Counter(str(path))


def test_token_query_equals_the_library(spark, sf, duck):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op6_token_counts(spark, sf).collect()}
    rows = duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    sizes = [len(e.ids) for e in library.encode_batch([t for _, t in rows], add_special_tokens=False)]
    assert got == {i: (len(t.encode()), n, n > 512) for (i, t), n in zip(rows, sizes)}


def test_chat_query_equals_a_plain_version(spark, sf, duck):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = duck.sql("SELECT conv_id, turn, role, coalesce(text, '') FROM conversations").fetchall() + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    want = {}
    for conv, own in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        own = list(own)
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        whole = "".join(f"{r[2]}\n{r[3]}\n" for r in own)
        want[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op7_chat_format(spark, sf).collect()}
    assert got == want


def test_a_very_long_text_and_a_very_long_conversation(spark, tmp_path):
    long = " ".join(f"word{i % 5000}" for i in range(300_000))
    turns = [(1, i, "assistant" if i % 2 else "user", "short") for i in range(3000)] + [(1, 3000, "assistant", long)]
    row = chat.digests(chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), queries.vocabulary())).collect()[0]
    assert (row.n_turns, row.loss_chars) == (3001, 1500 * 5 + len(long))
    docs = spark.createDataFrame([(1, long), (2, long), (3, "x")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.dedup.n_removed for r in substrings.remove_repeats(docs).collect()} == {1: 0, 2: 300_000, 3: 0}
    pages = spark.createDataFrame([(1, "http://h/" + "a😀" * 60_000), (2, "a😀" * 60_000 + "://h/p"), (3, "/" * 200_000), (4, "http://h/p" + "/" * 200_000)], "page_id long, url string")
    rows = {r.page_id: r for r in urlfilter.judge(pages, pages.select(urlfilter.canonical(F.col("url")).alias("canonical")).filter("length(canonical) < 9"), queries.RULES).collect()}
    assert (rows[1].host, len(rows[1].path), rows[2].path, rows[3].host) == ("h", 120_001, "/p", "") and rows[4].listed and not rows[1].listed
    warc.register(spark)
    path = str(tmp_path / "long")
    warc.page_records(spark.createDataFrame([(1, "u", long * 3)], "page_id long, url string, html string")).write.format("warc").mode("append").save(path)
    assert bytes(warc.read(spark, path).collect()[0].payload).decode() == long * 3


def test_language_model_and_path_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, k = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        scores = rng.integers(-9, 9, (n, k)).astype(np.float32)
        best = max(sum(scores[i, s] for i, s in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:])) for path in itertools.product(range(k), repeat=n))
        path = language.viterbi(scores, np.array([0]), np.array([n]), 3.0).tolist()
        assert sum(scores[i, s] for i, s in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:])) == best


def test_language_weights_equal_plain_counts(spark):
    docs = [("ab ab ba", "x"), ("ba bab", "y"), ("это", "z")]
    model = language.fit(spark.createDataFrame(docs, "text string, lang string"))
    for at, (text, _) in enumerate(docs):
        counts = np.zeros(language.BUCKETS)
        for word in text.split():
            np.add.at(counts, language.features([word])[0], 1)
        want = np.log((counts + language.SMOOTHING) / (counts.sum() + language.SMOOTHING * language.BUCKETS))
        assert np.allclose(model.weights[at], want, atol=1e-5)
    words = ["ab", "bab", "это"]
    table = model.scores(words)
    for i, word in enumerate(words):
        own = [language.SCALE * sum(w[b] for b in language.features([word])[0]) for w in model.weights]
        assert int(np.argmax(table[i])) == int(np.argmax([s if table[i][j] > -999 else -1e9 for j, s in enumerate(own)]))


def test_language_where_the_package_is_not_installed(tmp_path):
    root = str(Path(__file__).resolve().parent.parent.parent)
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from fitloom.llm import language
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").getOrCreate()
docs = spark.createDataFrame([("some text", "en")], "text string, lang string")
print("lang", language.identify(docs, language.fit(docs)).collect()[0].language.lang)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "lang en" in out.stdout, out.stderr[-2000:]


def test_one_source_is_not_put_in_order(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "only") for i in range(500)], "doc_id long, text string, source string")
    assert all(r.copies == 1 and r.target == r.source_size for r in mixing.mix(docs).collect())
    rows = mixing.mix(docs.withColumn("source", F.col("doc_id") % 3), weight=lambda size: size).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
        assert r.taken <= 3 * r.size
    assert len(by) == 3 and all(abs(a - b) <= 7 for a, b in by.values())


def test_pareto_ranks_equal_a_plain_version(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice("abcde")) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    found = {r.doc_id: r for r in mixing.mix(docs, weight=lambda size: F.when(size >= 20, 2.0).otherwise(1.0)).collect()}
    for source in "abcde":
        own = [(i, t.count("w")) for i, t, s in rows if s == source]
        target, total = found[own[0][0]].target, sum(n for _, n in own)
        mean = sum((2 if n >= 20 else 1) * n for _, n in own) / total
        keyed, certain = [], {}
        for i, n in own:
            x = min(target / total * ((2.0 if n >= 20 else 1.0) / mean), 3.0)
            certain[i], p = int(x), x - int(x)
            u = (int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            if certain[i] < 3:
                keyed.append(((u / (1 - u)) / (p / (1 - p)) if p else 1e300, u, i, n))
        need, run, drawn = target - sum(certain[i] * n for i, n in own), 0, set()
        for _, _, i, n in sorted(keyed):
            run += n
            if run <= need:
                drawn.add(i)
        got = {i for i, _ in own if found[i].copies > certain[i]}
        assert drawn <= got and len(got - drawn) <= 1


def test_long_runs_without_a_space_are_counted_fast_and_as_the_library_counts():
    import random
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    from fitloom.llm import tokencount

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter, rng = Tokenizer.from_file(path), tokencount.Counter(path), random.Random(9)
    texts = ["".join(rng.choices("etaoinshrdlu", k=200_000)), "a" * 5001, "ab" * 3000, "=-" * 4000, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(5000)), "kurz " + "x" * 5000 + " und " + "yz" * 3000, ""]
    for n in (tokencount.LONG - 1, tokencount.LONG, tokencount.LONG + 1):
        texts += ["".join(rng.choices("abé", k=n)), "the" * (n // 3) + "x" * (n % 3)]
    began = time.time()
    found = counter.count(texts).tolist()
    assert time.time() - began < 20
    assert found == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    alone = tokencount.Counter(path)
    pieces = ["".join(rng.choices("ntiohe", k=rng.randrange(1, 400))) for _ in range(300)]
    assert alone.merged_short([p.encode() for p in pieces]).tolist() == [alone.merged_long(p.encode()) for p in pieces]


def test_token_counts_of_empty_tables_and_repeated_rows(spark):
    import public_tokenizers

    from fitloom.llm import tokencount

    docs = spark.createDataFrame([(1, "ab cd"), (1, "ab cd"), (None, None), (2, "")], "doc_id bigint, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert sorted(r.n_tokens for r in tokencount.token_counts(docs, path).collect()) == [0, 0, 2, 2] and tokencount.token_counts(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("kind", ["plain", "weighted", "long", "tiny", "same"])
def test_mixed_words_come_near_their_targets(spark, kind):
    """Off by 1 % or half of the smallest document left at most; where all are at their limit, as near as they can be."""
    import random

    rng = random.Random(kind)
    rows = []
    for s in range(9):
        n = rng.choice([40, 150, 400])
        for i in range(n):
            size = {"plain": rng.randrange(5, 300), "weighted": rng.randrange(5, 300), "long": rng.choice([rng.randrange(1, 40), rng.randrange(2000, 9000)]), "tiny": 4000 if i == 0 else rng.randrange(1, 4), "same": 50}[kind]
            rows.append((len(rows), f"s{s}", "w " * size))
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    weight = {"plain": None, "weighted": lambda size: F.when(size >= 100, 2.0).when(size >= 50, 0.3).otherwise(0.01 + size / 100), "long": lambda size: F.when(size >= 100, 5.0).otherwise(1.0)}.get(kind)
    by = {}
    for r in mixing.mix(docs, weight=weight).collect():
        by.setdefault(r.source, []).append(r)
    assert len(by) == 9
    for source, found in by.items():
        off, target = abs(sum(r.taken for r in found) - found[0].target), found[0].target
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in found)
        left = [r.size for r in found if r.copies < 3]
        # One document of 4,000 words among few short ones: half of it may lack.
        assert off <= max(0.01 * target, 2000 if kind == "tiny" else min(left, default=0) / 2) + 1e-6, (source, off, target)


def test_a_source_at_its_limit_takes_all_it_has(spark):
    """Short documents weigh little, yet the target is three times all words."""
    docs = spark.createDataFrame([(i, "a" if i < 60 else "b", "w " * (10 if i % 2 else 200)) for i in range(2000)], "doc_id bigint, source string, text string")
    rows = [r for r in mixing.mix(docs, weights=(50, 1), weight=lambda size: F.when(size >= 100, 2.0).otherwise(0.1)).collect() if r.source == "a"]
    assert rows[0].target == 3 * rows[0].source_size and sum(r.taken for r in rows) == rows[0].target
