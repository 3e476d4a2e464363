"""Operators over pages and vectors, against brute force and on odd rows."""

import base64
import gzip
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import topk, warc
from logloom.llm.nndescent import Descent, near_duplicates

# 5


def test_arc_versions_are_parsed_by_declared_length():
    records = [("http://x.org/a", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n\n\nhttp://x 1 2 3 4\n"), ("dns:x.org", "200102030405", "text/dns", b""), ("http://y.org/", "20010203040506", "text/html", b"no http")]
    for version in (1, 2):
        found = list(warc.parse_arc(warc.write_arc(records, version)))
        assert [(r.fields["URL"], r.fields["Archive-date"], r.fields["Content-type"], r.block) for r in found] == records
        assert {r.version for r in found} == {version} and ("Result-code" in found[0].fields) == (version == 2)
    assert list(warc.parse_arc(b"")) == []
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.write_arc(records, 1)[:-20]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://x 0.0.0.0 20010203040506 text/html 0\n"))


def test_conversion_synthesises_warc_fields():
    block = b"HTTP/1.0 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    (record,) = warc.parse_arc(warc.write_arc([("http://x/", "20010203040506", "text/html", block)], 1))
    out = warc.to_warc(record)
    (fields, got), = warc.WarcStream().feed(out + warc.END)
    assert got == block and fields["WARC-Type"] == "response" and fields["WARC-Date"] == "2001-02-03T04:05:06Z" and fields["WARC-Payload-Digest"] == f"sha1:{warc.digest(b'abc')}"
    assert fields["WARC-Record-ID"] == warc.record_id("http://x/", "2001-02-03T04:05:06Z", warc.digest(b"abc"), "") and fields["WARC-Block-Digest"] == f"sha1:{warc.digest(block)}"
    assert warc.iso_date("199901") == "1999-01-01T00:00:00Z" and warc.iso_date("200102030405") == "2001-02-03T04:05:00Z"
    (plain,) = warc.parse_arc(warc.write_arc([("dns:x", "20010203040506", "text/dns", b"1.2.3.4")], 2))
    (fields, got), = warc.WarcStream().feed(warc.to_warc(plain) + warc.END)
    assert fields["WARC-Type"] == "resource" and got == b"1.2.3.4" and fields["Content-Type"] == "text/dns"


def test_stream_takes_any_cuts():
    block = b"HTTP/1.0 200 OK\r\n\r\n" + b"WARC/1.1\r\n\r\n\r\n" * 3
    (record,) = warc.parse_arc(warc.write_arc([("http://x/", "20010203040506", "text/html", block)], 1))
    whole = (warc.to_warc(record) + warc.END) * 3
    stream = warc.WarcStream()
    assert [b for i in range(0, len(whole), 7) for _, b in stream.feed(whole[i : i + 7])] == [block] * 3 and not stream.held


def test_round_trip(spark):
    pages = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "a b\n", ""), (5, "http://c", "é\r\n\r\nWARC/1.1\r\n\r\n"), (6, "http://d", "y" * 300_000), (2, "http://b", "<p>x</p>"), (None, "http://e", "<p>x</p>"), (None, "http://f", "alone")]
    frame = spark.createDataFrame([(*p, 0, "k") for p in pages], "page_id long, url string, html string, digest int, first string")
    found = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(frame).collect()), key=repr)
    wanted = []
    for i, _, html in pages:
        data = (html or "").encode()
        same = [j for j, _, h in pages if (h or "") == (html or "")]
        top = max((j for j in same if j is not None), default=None)
        revisit = i != top
        wanted.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert found == sorted(wanted, key=repr)
    assert {r["record_type"] for r in warc.round_trip(frame, least_bytes=9).collect() if r["payload_bytes"] < 9} == {"response"}
    assert warc.round_trip(frame.limit(0)).count() == 0


@pytest.mark.parametrize("end", ["\r\n", "\r\n" * 2, "\r\n" * 3, "\r", "\n", "\r\n\r"])
def test_round_trip_of_files_that_end_in_line_ends(spark, end):
    pages = spark.createDataFrame([(i, "http://a", f"<p>{i}</p>{end}") for i in range(12)], "page_id long, url string, html string")
    for n in (1, 12):
        found = {r["page_id"]: r["payload_bytes"] for r in warc.round_trip(pages.limit(n)).collect()}
        assert found == {i: len(f"<p>{i}</p>{end}") for i in range(n)}


@pytest.mark.parametrize("most", [400_000, 0])
def test_round_trip_with_and_without_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    monkeypatch.setattr(warc, "HEAVY", 10)
    htmls = ["common"] * 30 + [f"pair {k // 2}" for k in range(20)] + [f"own {k}" for k in range(10)] + [None, ""]
    pages = spark.createDataFrame([(i, f"http://{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    tops = {(h or ""): i for i, h in enumerate(htmls)}
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert found == {i: ("response", None) if tops[h or ""] == i else ("revisit", tops[h or ""]) for i, h in enumerate(htmls)}


def test_folders_of_arc_files(spark, tmp_path):
    folder, out = tmp_path / "arc", tmp_path / "warc"
    folder.mkdir()
    http = b"HTTP/1.0 200 OK\r\n\r\n<p>\xff</p>\r\n\r\n"
    records = [("http://x.org/a b".replace(" ", "%20"), "20010203040506", "text/html", http), ("dns:x.org", "200102030405", "text/dns", b"1.2.3.4"), ("http://y.org/", "20010203040506", "text/html", b"")]
    (folder / "one.arc").write_bytes(warc.write_arc(records, 1))
    whole = warc.write_arc(records[:2], 2)
    cut = whole.index(b"\nhttp")
    (folder / "two.arc.gz").write_bytes(gzip.compress(whole[:cut]) + gzip.compress(whole[cut:]))
    (folder / "other.txt").write_bytes(b"no archive")
    rows = sorted((r["file"].rsplit("/", 1)[-1], r["number"], r["version"], r["url"], r["date"], bytes(r["block"])) for r in warc.read_arc(spark, str(folder)).collect())
    assert rows == [("one.arc", k, 1, r[0], r[1], r[3]) for k, r in enumerate(records)] + [("two.arc.gz", k, 2, r[0], r[1], r[3]) for k, r in enumerate(records[:2])]
    warc.convert_arc(spark, str(folder), str(out))
    found = {}
    for path in out.glob("*.gz"):
        stream = warc.WarcStream(surplus=True)
        for fields, block in stream.feed(gzip.decompress(path.read_bytes())):
            assert fields["WARC-Block-Digest"] == f"sha1:{warc.digest(block)}"
            found[fields["X-Key"]] = (fields["WARC-Type"], fields["WARC-Date"], block)
    assert found["one.arc:0"] == ("response", "2001-02-03T04:05:06Z", http) and found["two.arc.gz:1"] == ("resource", "2001-02-03T04:05:00Z", b"1.2.3.4") and len(found) == 5
    (folder / "broken.arc").write_bytes(whole[:-20])
    with pytest.raises(Exception, match="declares|no header line"):
        warc.read_arc(spark, str(folder)).collect()


# 6


def vectors(seed=1, dim=12):
    r = np.random.default_rng(seed)
    out = []
    for c in range(60):
        base = r.normal(size=dim)
        for _ in range(int(r.integers(1, 6)) if c else 90):
            out.append(((base + r.normal(size=dim) * r.choice([0, 0.02, 0.06])).astype(np.float32).tolist(), int(r.integers(0, 2)) if c else 0))
    return [(i, v, label) for i, (v, label) in enumerate(out)]


ODD = [(900, None, 1), (901, [0.0] * 12, 1), (902, [1.0, None] + [0.0] * 10, 1), (903, [float("nan")] + [1.0] * 11, 1), (904, [1.0] * 12, None), (905, [], 1), (906, [1.0] * 3, 1), (907, [2.0] * 3, 1), (None, [1.0] * 3, 1), (908, [float("inf")] + [1.0] * 11, 1)]


def brute_links(rows, threshold):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    up = {i: i for i, _, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(up, 0)
    for a, (i, v, k) in enumerate(rows):
        for j, w, m in rows[:a]:
            if usable(v, k) and usable(w, m) and k == m and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    p, q = root(i), root(j)
                    up[max(p, q)] = min(p, q)
    return {i: (links[i], root(i)) for i in up}


def test_nn_descent_against_brute_force(spark):
    rows = vectors() + ODD
    frame = spark.createDataFrame([(*r, 0, "k") for r in rows], "vec_id long, embedding array<float>, label int, id int, unit string")
    found = near_duplicates(frame, Descent(length=4))
    wanted = brute_links([r for r in rows if r[0] is not None], 0.98)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect() if r["vec_id"] is not None}
    assert found.count() == len(rows) and set(got) == set(wanted)
    there = sum(n for n, _ in wanted.values())
    assert sum(min(got[i][0], wanted[i][0]) for i in wanted) >= 0.95 * there and all(got[i][0] <= wanted[i][0] for i in wanted)
    assert [got[i] for i in (900, 901, 902, 903, 904, 905, 906, 907, 908)] == [(0, 900), (0, 901), (0, 902), (0, 903), (0, 904), (0, 905), (1, 906), (1, 906), (0, 908)]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.collect() if r["vec_id"] is not None)
    assert near_duplicates(frame.limit(0)).count() == 0


def two_groups(members=200, others=400, dim=64):
    """Two groups of closest copies at a cosine of 0.985 from each other, among other vectors of the label."""
    r = np.random.default_rng(7)
    a, b = np.linalg.qr(r.normal(size=(dim, 2)))[0].T
    b = 0.985 * a + np.sqrt(1 - 0.985**2) * b
    near = np.concatenate([c + r.normal(size=(members, dim)) * 1e-4 for c in (a, b)])
    every = np.concatenate([near, r.normal(size=(others, dim))])
    return [(i, v.tolist(), 0) for i, v in enumerate(every)]


def test_groups_stay_together_when_closer_copies_fill_the_lists(spark):
    frame = spark.createDataFrame(two_groups(), "vec_id long, embedding array<double>, label int")
    found = near_duplicates(frame).where("vec_id < 400").select("n_links", "component_id").distinct().collect()
    assert [tuple(r) for r in found] == [(399, 0)]


def test_lone_pairs_are_found_beside_a_large_group(spark):
    r = np.random.default_rng(11)
    one = r.normal(size=(600, 64))
    one /= np.sqrt((one * one).sum(1))[:, None]
    side = r.normal(size=one.shape)
    side -= (side * one).sum(1)[:, None] * one
    side /= np.sqrt((side * side).sum(1))[:, None]
    group = r.normal(size=64) + r.normal(size=(500, 64)) * 1e-3
    every = np.concatenate([one, 0.985 * one + np.sqrt(1 - 0.985**2) * side, r.normal(size=(9000, 64)), group])
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(frame).collect()}
    assert [i for i in range(600) if found[i] != (1, i) or found[600 + i] != (1, i)] == []
    assert {found[i] for i in range(10200, 10700)} == {(499, 10200)} and all(found[i] == (0, i) for i in range(1200, 10200))


def test_large_labels_are_closed_where_the_audit_misses_links(spark, monkeypatch):
    from logloom.llm import nndescent

    rows = vectors(21)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    wanted = brute_links(rows, 0.98)
    monkeypatch.setattr(nndescent, "descend", lambda nodes, plan, scratch: (nodes.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("sim")).limit(0),) + (nodes.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0),))
    found = near_duplicates(frame, Descent(close_most=0))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()} == wanted
    monkeypatch.setattr(nndescent, "_missed", lambda nodes, labels, linked, threshold: nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    with pytest.raises(RuntimeError, match="links are missed"):
        near_duplicates(frame, Descent(close_most=0))


@pytest.mark.parametrize("close_most", [0, 30, 1 << 20])
def test_links_do_not_depend_on_the_size_of_a_label(spark, monkeypatch, close_most):
    from logloom.llm import nndescent

    rows = [*vectors(21), *((2000 + i, [1.0, 0.01 * i, 0.0], 9) for i in range(4))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    # Neither the descent nor the audit's sample meets any link.
    monkeypatch.setattr(nndescent, "descend", lambda nodes, plan, scratch: (nodes.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("sim")).limit(0),) + (nodes.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0),))
    monkeypatch.setattr(nndescent, "_audit", lambda *_: [])
    found = near_duplicates(frame, Descent(close_most=close_most))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()} == brute_links(rows, 0.98)


def test_ids_with_several_vectors_and_repeats(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, a, 0), (2, a, 0), (3, b, 0), (4, [1.0, 0.0, 0.11], 0)]
    found = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert found == [(1, 1, 1, True), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 1, 1, False), (4, 3, 1, False)]


# 8


def brute_top(rows, k, scale):
    def whole(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    held = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if i is not None and whole(v)]
    out = []
    for i, q in held:
        if i % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in held if j != i and len(c) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("factor, blocks", [(1.0, 4096), (1.0, 16), (3e6, 16)])
def test_top_k_against_brute_force(spark, monkeypatch, factor, blocks):
    monkeypatch.setattr(topk, "CANDIDATES", blocks)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "DIMENSIONS", 4)
    rows = [(i, None if v is None else [x if x is None else float(round(x, 1)) * factor for x in v], k) for i, v, k in vectors(3) + ODD]
    frame = spark.createDataFrame([(*r, 0, "k") for r in rows], "vec_id long, embedding array<double>, label int, id int, score string")
    found = topk.top_k(frame, F.col("id") % 5 == 0, k=7)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 7, 64.0)


def test_top_k_of_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0]), (20, [1.0]), (21, [2.0])], "vec_id long, embedding array<double>")
    found = topk.top_k(frame, F.col("id") % 20 == 0)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 21, 8192), (0, 2, 20, 4096), (20, 1, 21, 8192), (20, 2, 0, 4096)]
    assert topk.top_k(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_bounds_drop_candidates_but_no_result():
    r = np.random.default_rng(5)
    q, c = np.floor(r.normal(size=(64, 3)) * 10), np.floor(r.normal(size=(64, 500)) * 10)
    c[:, 100:] = np.floor(c[:, 100:] / 30)
    least = np.sort(q.T @ c, axis=1)[:, -5]
    got = set(zip(*[x.tolist() for x in topk.block_scores(q, c, least)], strict=True))
    full = q.T @ c
    assert got == {(i, j, int(full[i, j])) for i in range(3) for j in range(500) if full[i, j] >= least[i]}


def test_bounds_drop_most_candidates_early():
    """Vectors whose length falls off over the dimensions, as those of models do; in any order of dimensions."""
    r = np.random.default_rng(6)
    shape = r.permutation(0.9 ** np.arange(64))[:, None]
    q, c = np.floor(r.normal(size=(64, 16)) * shape * 64), np.floor(r.normal(size=(64, 4000)) * shape * 64)
    full = q.T @ c
    least, left = np.sort(full, axis=1)[:, -20], []
    got = set(zip(*[x.tolist() for x in topk.block_scores(q, c, least, left)], strict=True))
    assert got == {(i, j, int(full[i, j])) for i, j in zip(*np.nonzero(full >= least[:, None]), strict=True)}
    assert left[0] < 2400 and left[1] < 600 and left[2] < 400


def test_small_types_hold_the_same_numbers():
    for top, kind in ((100, "int8"), (1000, "int16"), (1e6, "int32"), (1e12, "float64")):
        m = np.floor(np.array([[top, -top / 2]]))
        assert topk.small(m).dtype == kind and (topk.small(m) == m).all()


def test_top_k_of_an_id_asked_with_two_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in topk.top_k(frame, F.col("id") % 20 == 0, k=2).collect())
    assert found == [(0, 1, 1, 12288), (0, 2, 2, 8192)]
