import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fitloom.llm import chat, language, mixing, quality, queries, tokencount, urlfilter, warc

ODD = ["", " ", "\t\n", "a", "ééé", "x" * 5000, "日本語 テキスト", "<|endoftext|>", "a<|endoftext|>b", "aaaaaaa", "don't we'll", "1234 5678", "a\x1cb\x85c\u2028d\xa0e", "  lead", "trail  ", "\r\n\r\n x", "🙂🙂 ok", "e\u0301"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_token_counts_equal_the_library(tokenizer, duck):
    rng = random.Random(5)
    texts = ODD + [r[0] for r in duck.sql("SELECT text FROM documents LIMIT 60").fetchall()]
    alphabet = ["a", "th", "e ", " ", "  ", "\n", "'s", "9", "é", "中", "\x1d", "\x85", "\u3000", "-", "!!", "<|", "|>", "ing", "🙂", "²", "\u0301"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    counter = tokencount.Counter(queries.vocabulary())
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == want


def test_token_counts_keep_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, None, 7), (1, None, 7), (None, "a b", 8), (2, "", 9)], "doc_id long, text string, n_tokens_x long")
    rows = tokencount.token_counts(docs, queries.vocabulary()).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows) == [(False, 0), (False, 0), (False, 0), (True, 2)]
    assert tokencount.token_counts(docs.limit(0), queries.vocabulary()).count() == 0


def test_chat_windows_read_back(spark):
    rng = random.Random(3)
    words = ["<|im_end|>", "<|im_start|>assistant", "<\\|", "<", "|", "ok", "\n", "é", "well then", "<\\\\|x"]
    rows = []
    for conv in range(12):
        for turn in range(rng.randrange(1, 30)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "odd\nro\\le<|"])
            text = rng.choice([None, "", "".join(rng.choice(words) for _ in range(rng.randrange(60)))])
            rows.append((conv, turn, role, text, 1))
    rows += [(None, 0, None, "null id", 1), (None, None, "assistant", "first", 1), (3, 2, "assistant", "tie", 1), (3, 2, "assistant", "tie", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window_no long")
    windows = chat.windows(turns, queries.vocabulary(), budget=120, history=40)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    assert max(r.n_windows for r in got.values()) > 3
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    counter = tokencount.Counter(queries.vocabulary())
    for w in windows.collect():
        n_turns = len(chat.read_turns(w.text))
        assert w.n_tokens <= 120 or n_turns - w.n_repeated <= 1 + (w.window_no == 0)
        assert w.n_tokens == sum(counter.count([p]).sum() for p in [chat.START + x for x in w.text.split(chat.START)[1:]])
    assert chat.digests(chat.windows(turns.limit(0), queries.vocabulary())).count() == 0


def test_language_of_held_out_texts(spark, sf):
    rows = queries.op4_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95


def test_language_edges_and_mixed_spans(spark):
    english = "the cat and the dog went over the hill with their friends then they had this and that "
    french = "le chat et le chien sont dans les rues avec des amis pour une nuit que nous avons "
    russian = "это просто текст который написан для проверки "
    docs = spark.createDataFrame([(english * 5, "en"), (french * 5, "fr"), (russian * 5, "ru"), (None, "en"), ("x", None)], "text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["en", "fr", "ru"]
    tests = [None, "", "123 ²", english, french + english, russian + english * 3, "ελληνικά", english * 3]
    rows = language.identify(spark.createDataFrame([(i, t, "c") for i, t in enumerate(tests)], "id int, text string, score string"), model).collect()
    found = {r.id: r.language for r in rows}
    assert [found[i].lang for i in (0, 1, 2)] == ["und"] * 3
    assert found[3].lang == "en" and found[7].lang == "en" and found[5].lang == "en"
    assert [s.lang for s in found[4].spans] == ["fr", "en"] and [s.lang for s in found[5].spans] == ["ru", "en"]
    assert abs(found[4].spans[0].end - 18) <= 1
    assert found[6].lang in model.languages and all(0 <= r.language.score <= 1 for r in rows)
    empty = language.fit(docs.limit(0))
    assert {r.language.lang for r in language.identify(docs.select("text"), empty).collect()} == {"und"}


def test_warc_round_trip_pushdown_and_splits(spark, tmp_path):
    warc.register(spark)
    big = "é" * 3000
    rows = [(1, "http://a/1", big), (2, None, big), (2, "http://a/2", "short"), (3, "http://a/3\r\nX: y", "short"), (None, "u", None), (5, "u", ""), (6, "u", "<p>\r\n\r\nWARC/1.1\r\n")]
    rows += [(100 + i, f"http://b/{i}", f"{i} " * 500) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = str(tmp_path / "w")
    warc.page_records(pages).repartition(3).write.format("warc").option("indexbytes", 900).mode("append").save(path)
    read = warc.read(spark, path, splitbytes="5000")
    found = {(r.record_id, r.target_uri): r for r in read.collect()}
    assert len(found) == len(rows) and read.rdd.getNumPartitions() > 6
    assert found["<urn:page:2>", None].warc_type == "revisit" and found["<urn:page:2>", None].refers_to == "<urn:page:1>"
    assert found["<urn:page:2>", None].payload_length == 6000
    for page_id, url, html in rows[3:]:
        r = next(r for k, r in found.items() if k[0] == f"<urn:page:{page_id if page_id is not None else 'null'}>" and r.warc_type == "response")
        assert bytes(r.payload) == (html or "").encode()
        assert r.payload_digest == hashlib.sha256((html or "").encode()).hexdigest()
    some = read.filter((F.col("payload_length") >= 6000) & F.col("target_uri").startswith("http://a")).select("record_id")
    assert [r.record_id for r in some.collect()] == ["<urn:page:1>"]
    narrow = warc.read(spark, path, "record_id string, warc_type string")
    assert narrow.filter("warc_type = 'revisit'").count() == 1
    empty = str(tmp_path / "e")
    warc.page_records(pages.limit(0)).write.format("warc").mode("append").save(empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "b.warc").write_bytes(one + two)
    warc.register(spark)
    rows = warc.read(spark, str(tmp_path), splitbytes="10").collect()
    assert sorted((r.warc_type, bytes(r.payload)) for r in rows) == [("metadata", b"abcd")] * 2 + [("response", b"hello")] * 2
    assert warc.read(spark, str(tmp_path)).filter("warc_type = 'metadata'").count() == 2


def test_url_rules_and_list(spark):
    urls = [None, "no scheme", "http://Example.ORG/es/x", "https://a.example.org/en/12", "http://example.org/en/2", "http://b.com/de/1", "http://com/fr/", "http://bad.net/x/?utm_source=a&b=2&a=1#t", "http://www.bad.net/x?a=1&b=2", "http://good.net/x", "x://", "a://b://c/d", "http://xorg/"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, listed_x string")
    listed = spark.createDataFrame([("https://bad.net/x?b=2&a=1",), (None,), ("https://bad.net/x?b=2&a=1",)], "url string").select(urlfilter.canonical(F.col("url")).alias("canonical"))
    rows = {r.page_id: r for r in urlfilter.judge(pages, listed, queries.RULES).collect()}
    assert len(rows) == len(urls)
    assert [rows[i].rule for i in range(7)] == [None, None, "example.org/es/", "example.org/en/1", "org/", "com/de/", "com/fr/"]
    assert [rows[i].verdict for i in range(13)] == ["allow", "allow", "block", "block", "allow", "block", "allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert (rows[0].host, rows[0].path, rows[1].host) == ("", "", "") and (rows[11].host, rows[11].path) == ("b:", "//c/d")
    assert {r.verdict for r in urlfilter.judge(pages, listed.limit(0), []).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    urls = spark.range(5000).select(F.concat(F.lit("h/"), F.col("id")).alias("canonical"))
    pages = spark.range(20000).select(F.concat(F.lit("h/"), F.col("id")).alias("canonical"))
    assert urlfilter.listed(pages, urls).groupBy("listed").count().orderBy("listed").collect() == [(False, 15000), (True, 5000)]


def test_mixing_edges(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "b", "c", "c", "c", None]), 1.0 + i % 3) for i in range(3000)]
    rows += [(None, None, "a", 1.0), (4000, "", "d", 1.0), (4001, " ", "d", 2.0), (5, "repeat it", "b", 1.0), (5, "repeat it", "b", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w double").withColumn("size", F.lit("clash"))
    for weight in (None, "w"):
        found = mixing.mix(docs, weight=weight).collect()
        assert len(found) == len(rows) and all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in found)
        by = {}
        for r in found:
            by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
        for taken, target, size in by.values():
            assert abs(taken - target) <= 10 and target <= 3 * size
        assert abs(sum(t for _, t, _ in by.values()) - sum(s for _, _, s in by.values())) < 1e-3
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), ("d", 1)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    left, full = {"a": 1, "b": 2, "c": 3, "d": 1}, {}
    total, size = 1021, {"a": 1000, "b": 10, "c": 10, "d": 1}
    while over := [s for s in left if (total - sum(full.values())) * left[s] / sum(left.values()) > 3 * size[s]]:
        full |= {s: 3 * size[s] for s in over}
        left = {s: w for s, w in left.items() if s not in full}
    want = full | {s: (total - sum(full.values())) * w / sum(left.values()) for s, w in left.items()}
    assert got == pytest.approx(want)


def test_quality_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "  \n\n", "a b c\na b c\n a b c\n\n\na b c", "#$ x " * 30, "x" * 9000] + ODD
    texts += ["\n".join(" ".join(rng.choice("abcd") + "é" * (rng.random() < 0.2) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(12))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "id int, text string, kept string")
    rows = {r.id: r.repetition for r in quality.repetition(docs.withColumn("repetition", F.lit(1))).collect()}
    for i, text in enumerate(texts):
        import re

        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]

        def hit(n):
            windows = [tuple(words[j : j + n]) for j in range(len(words) - n + 1)]
            return {j + k for j, w in enumerate(windows) if windows.count(w) > 1 for k in range(n)}

        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(words), sum(map(len, words)), len(lines) - len(set(lines))), text
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "") and r.n_repeat_words == len(hit(8))
        total = max(1, sum(map(len, words)))
        assert r.dup_gram_shares == pytest.approx([sum(len(words[j]) for j in hit(n)) / total for n in sorted(quality.MAX_COVERAGE)])
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs.limit(0)).count() == 0
