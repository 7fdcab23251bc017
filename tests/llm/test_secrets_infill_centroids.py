"""Secret scans, fill-in-middle and centroid clustering: plain versions over whole tables, and edge cases by hand."""

import base64
import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.llm import centroids, infill, queries, secretscan

DOCS = "doc_id bigint, text string"


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def scanned(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return [[tuple(s) for s in r.secrets] for r in secretscan.scan(docs, *vocabulary(), **more).orderBy("doc_id").collect()]


def base_spans_plain(text):
    """The contract's words, by hand-written loops over the kinds' rules."""
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for order, kind, letters, least in ((1, "access", string.ascii_uppercase + string.digits, 16), (2, "hex", "0123456789abcdef", 32)):
        i = 0
        while i < len(text):
            lead = 4 if kind == "access" else 0
            if lead and text[i : i + 4] != "AKIA":
                i += 1
                continue
            j = i + lead
            while j < len(text) and text[j] in letters:
                j += 1
            if j == i + lead:
                i += 1
                continue
            if j - i >= least:
                out.append((i, order, f"{kind}:{i}:{j}"))
            i = j
    return [s for _, _, s in sorted(out)]


def test_secret_query_equals_a_plain_version(spark, sf, duck, tmp_path):
    """Into every third text something of each kind is planted, or what nearly is."""
    planted = ["é 'API_KEY' : \"x.y=z/abc+\" ", "xxAKIA0123456789AB AKIA1234 ", "0123456789abcdef" * 2 + "g" + "f" * 31, " passwd=1234567 secret = token=abcdefgh"]
    texts = {i: (planted[i // 3 % 4] + t[:50] + planted[i // 3 % 4] + t[50:] if i % 3 == 0 else t) for i, t in duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()}
    spark.createDataFrame(list(texts.items()), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_secret_scan(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) and any(r.n_assign for r in rows)
    for r in rows:
        want = base_spans_plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == want
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]


def test_base_kinds(spark):
    got = scanned(spark, [
        "é TOKEN = 'abcdefgh' and token=short", "secret:token :abcdefgh", "xAKIAABCDEFGHIJKL AKIAABC", "g" + "0a" * 16 + "z" + "ab" * 15, None, "", "toKen=abcdefghij", "api_key: 12345678 apikey=12345678",
    ])
    assert got[0] == [("assign", 2, 19)] and got[1] == [] and got[2] == [("access", 1, 17)]
    assert [s for s in got[3] if s[0] != "random"] == [("hex", 1, 33)] and got[4:7] == [[], [], []] and [s[0] for s in got[7]] == ["assign", "assign"]


def test_random_strings_and_what_only_looks_so(spark):
    rng = random.Random(5)
    drawn = ["".join(rng.choices(string.ascii_letters + string.digits, k=32)) for _ in range(50)]
    found = scanned(spark, [f"value {d} end" for d in drawn])
    assert sum(f == [("random", 6, 38)] for f in found) >= 49
    clean = [
        "getElementByIdentifierOrName", "Donaudampfschifffahrtsgesellschaft", "chpfheitschverheiten und", "123e4567-e89b-12d3-a456-426614174000", f"https://example.org/{drawn[0]}/x?y=1",
        "mail " + drawn[1] + "@example.org", "doi 10.1234/" + drawn[2], "data:image/png;base64," + drawn[3] * 9, "sha256-" + (drawn[4] * 2)[:43] + "=", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709",
        "12345678901234567890123", "GB29NWBK60161331926819", "2024-01-01/2024-02-02/2024",
    ]
    assert scanned(spark, clean) == [[]] * len(clean)
    # A secret in an address's query or user is one; a run in a base span isn't told twice; one beside it is.
    more = scanned(spark, [f"https://example.org/a?k={drawn[5]}", f"https://u:{drawn[6]}@example.org/", f"token={drawn[7]}", f"token={drawn[7]} {drawn[8]}"])
    assert [[s[0] for s in x] for x in more] == [["random"], ["random"], ["assign"], ["assign", "random"]]


def test_digests_are_no_random_strings_but_stay_hex_spans(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    assert scanned(spark, [f"id {digest}", f"id {digest[:50]}"]) == [[("hex", 3, 67)], [("hex", 3, 53)]]


def test_secret_scan_of_a_very_long_text_and_odd_tables(spark):
    rng = random.Random(6)
    blob = "".join(rng.choices(string.ascii_letters + string.digits, k=300_000))
    text = "wort " * 200_000 + blob + " ende"
    assert scanned(spark, [text, text]) == [[("random", 1_000_000, 1_300_000)]] * 2
    assert scanned(spark, []) == []
    docs = spark.createDataFrame([(None, "password: abcdefgh1", 1, "x")], "doc_id bigint, text string, secrets int, `row` string")
    got = secretscan.scan(docs, *vocabulary())
    assert got.columns == ["doc_id", "text", "row", "secrets"] and [s.kind for s in got.first().secrets] == ["assign"]


def test_redaction_of_spans(spark):
    docs = spark.createDataFrame([(1, "é token=abcdefgh, AKIAABCDEFGHIJKL."), (2, "plain"), (3, None)], DOCS)
    got = secretscan.scan(docs, *vocabulary()).orderBy("doc_id").select(secretscan.redacted(F.col("text"), F.col("secrets"))).collect()
    assert [r[0] for r in got] == ["é [SECRET], [SECRET].", "plain", None]


def test_ratio_is_counted_in_pieces():
    scanner = secretscan.Scanner(*vocabulary())
    assert scanner.ratio("x" * 5000) > 0 and scanner.ratio("the" * 10) > 2.0
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary()[0], "rb"))}
    assert scanner.ratio("a") == 1 and b"the" in ranks


# Fill-in-middle.


def filled(spark, rows, **more):
    docs = spark.createDataFrame(rows, DOCS)
    out = infill.transform(docs, seed=7, **more)
    return out.select("doc_id", "fim.*", infill.restored(F.col("fim.output"), F.col("fim.form")).alias("restored"), F.coalesce("text", F.lit("")).alias("text")).collect()


def test_fill_in_middle_round_trip_of_odd_texts(spark):
    texts = [None, "", "\n", "a", "a\nb", "\n\n\n", "x<P>y", "<", "a<\n<S", "S>\n<", "é\r\nü z\n", "a\x00b\n", "l\n" * 300_000, "w" * 500_000]
    for r in filled(spark, list(enumerate(texts)) + [(None, "a\nb\nc")]):
        assert r.restored == r.text and r.n == len(re.findall(r"[^\n]*\n|[^\n]+", r.text))
        if r.form == "plain":
            assert r.output == r.text and r.prefix_chars is None and r.middle_chars is None and (not r.text or "<P>" in r.text)
            continue
        a, b = r.prefix_chars, r.prefix_chars + r.middle_chars
        p, m, s = r.text[:a], r.text[a:b], r.text[b:]
        assert r.output == (f"<P>{p}<S>{s}<M>{m}" if r.form == "psm" else f"<S>{s}<P>{p}<M>{m}")
        assert all(part == "" or part.endswith("\n") or r.text.endswith(part) for part in (p, r.text[:b]))


def test_fill_in_middle_rates_ties_and_odd_columns(spark):
    rows = [(i, f"a{i}\nb\nc\nd") for i in range(400)]
    forms = [r.form for r in filled(spark, rows, percent=50, spm_percent=100)]
    assert set(forms) == {"plain", "spm"} and 150 < forms.count("spm") < 250
    again = filled(spark, [(1, "a\nb\nc")] * 3)
    assert len(set(again)) == 1
    docs = spark.createDataFrame([(1, "a\nb", "x", 2, 3)], "doc_id bigint, text string, fim string, digest int, `row` int")
    assert infill.transform(docs, seed=7).columns == ["doc_id", "text", "digest", "row", "fim"] and infill.transform(docs, seed=7).count() == 1
    assert filled(spark, []) == []


# Centroid clustering.

VECTORS = "vec_id bigint, embedding array<float>"


def brute(rows, k, rounds, dims, scale=256, seed=2):
    """vec_id to (cluster, distance), in Python integers."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]

    def assigned():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assigned()
        for j in range(len(c)):
            mine = [v for (_, v), (x, _) in zip(kept, at) if x == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    at = assigned()
    inertia = {j: sum(d for x, d in at if x == j) for j in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted((i if i is not None else -10**9, x, d, inertia[x], sum(inertia.values()), digest[x]) for (i, _), (x, d) in zip(kept, at))


def clustered(spark, rows, ddl=VECTORS, **more):
    found = centroids.clusters(spark.createDataFrame(rows, ddl), scale=256, seed=2, **more)
    found = found.withColumn("digest", centroids.digest(F.col("centroid")))
    return sorted((r.vec_id if r.vec_id is not None else -10**9, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.digest) for r in found.collect())


@pytest.mark.parametrize("n,k,dims,rounds", [(300, 7, 4, 5), (150, 20, 64, 3), (5, 9, 3, 2), (60, 1, 2, 4), (200, 6, 3, 40)])
def test_clusters_equal_brute_force(spark, n, k, dims, rounds):
    rng = np.random.default_rng(n)
    rows = [(i, (rng.normal(size=dims) + rng.integers(0, 4)).tolist()) for i in range(n)]
    assert clustered(spark, rows, k=k, rounds=rounds, dims=dims) == brute(rows, k, rounds, dims)


def test_clusters_of_ties_repeated_rows_and_unfit_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 2), 1.0]) for i in range(40)] + [(7, [1.0, 1.0])] * 30 + [(None, [0.5, 0.5]), (90, None), (91, [1.0]), (92, [1.0, None]), (93, [nan, 1.0]), (94, [inf, 1.0]), (95, []), (96, [-0.001, -3.0])]
    assert clustered(spark, rows, k=6, rounds=5, dims=2) == brute(rows, 6, 5, 2)
    same = [(i, [1.0, 2.0]) for i in range(50)]
    found = clustered(spark, same, k=3, rounds=2, dims=2)
    assert found == brute(same, 3, 2, 2) and {r[1] for r in found} == {0}


def test_clusters_of_empty_and_odd_tables(spark):
    assert clustered(spark, [], k=3, rounds=2, dims=2) == [] and clustered(spark, [(1, None)], k=3, rounds=2, dims=2) == []
    assert clustered(spark, [(1, [1.0, 2.0], 5, "x"), (2, [3.0, 1.0], 6, "y")], VECTORS + ", cluster int, id string", k=2, rounds=2, dims=2)[0][0] == 1
    with pytest.raises(Exception, match="beyond"):
        clustered(spark, [(1, [1e9, 2.0])], k=1, rounds=1, dims=2)


def test_pivots_spare_distances_and_change_nothing():
    rng = np.random.default_rng(1)
    v = (rng.integers(0, 5, (2000, 1)) * 400 + rng.normal(size=(2000, 64)) * 40).astype(np.int64)
    c = v[:40]
    pivots = centroids._spread_out(c, 8)
    at, d, tried = centroids.nearest(v, centroids.to_pivots(v, pivots), c, pivots)
    every = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (at == every.argmin(1)).all() and (d == every.min(1)).all() and tried < 0.3 * every.size
