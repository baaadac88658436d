"""Real files: the rules of reading, cutting and leaving out."""

import gzip

import pytest
from pyspark.sql import functions as F

from emberlog.plans.triage import triage
from emberlog.sources import walk
from emberlog.sources.files import LogFiles, application_path, normalised_path, with_path_columns

import line_machine as machine

E, W, I, D = (f"20/06/06 22:25:17 {level} A: " for level in ("ERROR", "WARN", "INFO", "DEBUG"))

TEXTS = {
    "newline_end/stderr.gz": f"{E}one\n\tat a\n",
    "no_newline_end/stderr.gz": f"{E}one\n\tat a",
    "blank_end/stderr.gz": f"{E}one\n ",
    "blank_line_end/stderr.gz": f"{E}one\n \n",
    "carriage/stderr.gz": f"{E}one\r\n\tat a\r\n{W}two\rhalf\n",
    "prelude/stderr.gz": "SLF4J: one\nSLF4J: two\n",
    "gap/stderr.gz": f"{E}one\n{D}x\nlost\n{E}two\n{W}three\n",
    "open_end/stderr.gz": f"{E}one\n{W}two\n{D}x\n",
    "cause/stderr.gz": f"{I}one\n\tCaused by: x\n{I}two\n",
    "cause_in_gap/stderr.gz": f"{I}one\n{D}x\n{I}Caused by: y\n",
    "other_date/stderr.gz": "2020-06-06 22:29:37 ERROR X: ok\n20/06/0 no header\n",
    "tab_first/stderr.gz": f"\tat needle\n{E}x\n\tat needle\n{E}y needle\nrest\nneedle too\n",
    "tab_later/stderr.gz": f"{E}needle\n{W}x\n\tat needle\nrest\n",
    "upper/stderr.gz": f"{E}NEEDLE one\n{E}Needle two\n",
    "wide/stderr.gz": f"{E}café 中文\n20/06/06 22:25:17 WARN wide blanks\n",
    "bom/stderr.gz": f"\ufeff{E}not a header\n{E}one\n",
    "empty/stderr.gz": "",
    "deep/er/mystderr.gz": f"{W}named\n",
    "sp ace+plus%/stderr.gz": f"{E}Executor self-exiting due to : Driver\n{E}ERROR Executor java.nio.file.AccessDeniedException\n",
}
SHORT = {
    "wide_short/stderr.gz": f"{E}one\n20/06/06\u2003x\u00a0\x1c\nneedle\n",
    "short/stderr.gz": f"{E}one\n20/06/06 x\n\tat needle\n",
    "short_end/stderr.gz": f"{E}needle\n20/06/06",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")

    def put(name, data):
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)

    for name, text in {**TEXTS, **SHORT}.items():
        put(name, gzip.compress(text.encode()))
    put("two_members/stderr.gz", gzip.compress(f"{E}one\n".encode()) + gzip.compress(b"\tat b\n"))
    put("not_gzip/stderr.gz", b"hello world, this is no gzip")
    put("truncated/stderr.gz", gzip.compress((f"{E}one\n" * 5000).encode())[:-200])
    put("bad_bytes/stderr.gz", gzip.compress(E.encode() + b"\xff\n"))
    put("plain/stderr", f"{E}plain\n".encode())
    put("other/stdout.gz", gzip.compress(f"{E}out\n".encode()))
    return str(root)


def expected(folder, full=True):
    texts = {**{n: t.removeprefix("\ufeff") for n, t in TEXTS.items()}, "two_members/stderr.gz": f"{E}one\n\tat b\n", **({} if full else SHORT)}
    return {f"{folder}/{name}": text for name, text in texts.items()}


LARGE = {"max_text_bytes": 0, "max_plain_bytes": 0, "rows_per_chunk": 2}


@pytest.fixture(params=["whole", "lines"])
def files(request, spark, folder):
    """Small files as whole texts, and the same files all treated as too large for that."""
    if request.param == "whole":
        return lambda texts: (LogFiles(spark, folder + "/"), texts)

    def readable_only(texts):
        # Unreadable files stop the large path, and an empty text has no lines to read.
        root = f"{folder}/"
        names = [n for n in texts if "/empty/" not in n]
        globs = "{" + ",".join(sorted({n[len(root):].split("/")[0] for n in names})) + "}"
        return LogFiles(spark, root + globs, **LARGE), {n: texts[n] for n in names}

    return readable_only


def test_pieces(files, folder):
    logs, texts = files(expected(folder))
    got = {tuple(r) for r in logs.pieces().select("container_id", "rec_no", "level", "raw").collect()}
    assert got == {(name, *piece) for name, text in texts.items() for piece in machine.pieces(text)}


def test_segments(files, folder):
    logs, texts = files(expected(folder))
    got = sorted(tuple(r) for r in logs.segments().select("container_id", "seg", "level", "record").collect())
    assert got == sorted(
        (name, i, *segment) for name, text in texts.items() for i, segment in enumerate(machine.segments(text), 1)
    )


@pytest.mark.parametrize(
    "keyword, full",
    [("needle", True), ("needle", False), ("NEEDLE", True), (",needle,one", False), (",", True), ("café", True), ("%", True)],
)
def test_spans(files, folder, keyword, full):
    logs, texts = files(expected(folder, full))
    first = [k for k in keyword.split(",") if k][:1]
    got = sorted(tuple(r) for r in logs.spans(keyword, "first", full).select("container_id", "hit_no", "hit").collect())
    assert got == sorted(
        (name, i, hit) for name, text in texts.items() for i, hit in enumerate(machine.spans(text, first), 1)
    )


def test_containers(files, folder):
    for full in (True, False):
        logs, texts = files(expected(folder, full))
        assert sorted(r[0] for r in logs.containers(full).collect()) == sorted(texts)


def test_quarantine(spark, folder):
    got = {r[0][len(folder) + 1 :]: r[1] for r in LogFiles(spark, folder).quarantine().collect()}
    assert got == {
        "not_gzip/stderr.gz": "unreadable",
        "truncated/stderr.gz": "unreadable",
        "bad_bytes/stderr.gz": "invalid_utf8",
        "short/stderr.gz": "short_header",
        "short_end/stderr.gz": "short_header",
        "wide_short/stderr.gz": "short_header",
    }


def test_large_quarantine(spark, folder):
    logs = LogFiles(spark, folder + "/{bad_bytes,short,gap}", **LARGE)
    got = {r[0][len(folder) + 1 :]: r[1] for r in logs.quarantine().collect()}
    assert got == {"bad_bytes/stderr.gz": "invalid_utf8", "short/stderr.gz": "short_header"}


def test_unreadable_large_file_costs_that_file_only(spark, folder):
    """All files as streams: what a damaged one gave before its fault is taken back, and the run goes on."""
    logs = LogFiles(spark, folder, **LARGE)
    small = LogFiles(spark, folder)
    assert {r[0][len(folder) + 1 :]: r[1] for r in logs.quarantine().collect()} == {r[0][len(folder) + 1 :]: r[1] for r in small.quarantine().collect()}
    order = ["container_id", "rec_no", "level", "raw"]
    assert sorted(map(tuple, logs.pieces().select(order).collect()), key=repr) == sorted(map(tuple, small.pieces().select(order).collect()), key=repr)
    rows = triage(spark, folder, "needle", **LARGE).rows().collect()
    assert not any("/truncated/" in r.container_id or "/not_gzip/" in r.container_id for r in rows) and len(rows) > 20


def test_damage_late_in_a_long_stream(spark, tmp_path):
    text = "".join(f"20/06/06 22:25:17 ERROR A: {i} {i * i}\n" for i in range(60_000)).encode()
    data = bytearray(gzip.compress(text))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "stderr.gz").write_bytes(data[:-9])
    data[len(data) * 3 // 4] ^= 0xFF
    (tmp_path / "flipped").mkdir()
    (tmp_path / "flipped" / "stderr.gz").write_bytes(data)
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "stderr.gz").write_bytes(gzip.compress(text))
    logs = LogFiles(spark, str(tmp_path), max_text_bytes=0, rows_per_chunk=10_000)
    assert {r[0].split("/")[-2]: r[1] for r in logs.quarantine().collect()} == {"cut": "unreadable", "flipped": "unreadable"}
    pieces = logs.pieces()
    assert {(r[0].split("/")[-2], r[1]) for r in pieces.groupBy("container_id").count().collect()} == {("good", 60_000)}
    assert pieces.agg(F.max("rec_no")).first()[0] == 60_000


def test_hidden_and_empty_files_have_entries(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)

    record = gzip.compress(f"{E}one\n".encode())
    for name in ("_hidden/stderr.gz", ".dot/a/stderr.gz", "shown/_stderr.gz", "shown/stderr.gz"):
        put(name, record)
    put("zero/stderr.gz", b"")
    put("_bad/stderr.gz", record[:-5])
    for limits in ({}, LARGE):
        run = triage(spark, str(tmp_path), "one", **limits)
        found = {r.container_id[len(str(tmp_path)) + 1 :]: r.n_error for r in run.container_summary().collect()}
        assert found == {"_hidden/stderr.gz": 1, ".dot/a/stderr.gz": 1, "shown/_stderr.gz": 1, "shown/stderr.gz": 1, "zero/stderr.gz": 0}
        assert [(r.container_id.split("/")[-2], r.reason) for r in run.quarantine().collect()] == [("_bad", "unreadable")]
    assert {r.n_bytes for r in LogFiles(spark, str(tmp_path)).listed().collect()} == {0, len(record), len(record) - 5}


def test_only_folders_of_an_application_are_listed(spark, tmp_path):
    for cluster in ("j-1", "j-2"):
        for application in ("app_1", "app_2", "app_3"):
            folder = tmp_path / cluster / "containers" / application / "c"
            folder.mkdir(parents=True)
            (folder / "stderr.gz").write_bytes(gzip.compress(f"{E}{cluster} {application}\n".encode()))
    root = str(tmp_path)
    one = LogFiles(spark, root, cluster_id="j-1", application_id="app_2")
    assert [r.container_id for r in one.listed().collect()] == [f"{root}/j-1/containers/app_2/c/stderr.gz"]
    assert [r.raw.split()[-1] for r in one.pieces().collect()] == ["app_2"]
    assert one._listing.rdd.getNumPartitions() == 1  # one folder is looked into
    both = LogFiles(spark, root, application_id="app_1")
    assert both._listing.rdd.getNumPartitions() == 2 and both.listed().count() == 2
    assert sorted(r.container_id.split("/")[-5] for r in both.segments().collect()) == ["j-1", "j-2"]
    files = walk.walk(spark, root, "*stderr.gz")
    assert files.filter("cluster_id in ('j-2') and application_id in ('app_1', 'app_2')").rdd.getNumPartitions() == 2
    assert files.filter("cluster_id = 'none'").count() == 0


def test_lines_of_a_stream():
    def cut(*pieces):
        return list(walk.cut_lines(iter(pieces)))

    assert cut(b"a\nb", b"c\n", b"\n", b"d") == [b"a", b"bc", b"", b"d"]
    assert cut(b"a\n") == [b"a", b""] and cut() == [b""] and cut(b"x", b"y") == [b"xy"]


def test_large_plain_file_is_split_into_blocks(spark, tmp_path):
    text = "".join(f"{E if n % 3 else D}row {n}\n" + "\tat needle\n" * (n % 4) for n in range(3000))
    (tmp_path / "stderr").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        logs = LogFiles(spark, str(tmp_path), "stderr", max_plain_bytes=0, rows_per_chunk=100)
        assert logs.large_lines().select("block").distinct().count() > 3
        pieces = logs.pieces().orderBy("rec_no").select("rec_no", "level", "raw").collect()
        segments = logs.segments().orderBy("seg").select("level", "record").collect()
        spans = logs.spans("needle").orderBy("hit_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in pieces] == machine.pieces(text)
    assert [tuple(r) for r in segments] == machine.segments(text)
    assert [r.hit for r in spans] == machine.spans(text, ["needle"])


def test_plain_pattern(spark, folder):
    assert [r[0] for r in LogFiles(spark, folder, "stderr").containers().collect()] == [f"{folder}/plain/stderr"]


def test_full_triage(spark, folder):
    with pytest.raises(ValueError, match="one"):
        triage(spark, folder, "needle,one")
    run = triage(spark, folder, "needle,one", match="first")
    texts = expected(folder)
    rows = run.rows().collect()
    lists = sorted((r.container_id, r.ord, r.section, r.text) for r in rows if r.section in machine.KNOWN)
    assert [(c, s, t) for c, _, s, t in lists] == [
        (name, *record) for name in sorted(texts) for record in machine.kept(texts[name])
    ]
    path = f"{folder}/sp ace+plus%/stderr.gz"
    buckets = sorted((r.section, r.pattern_no, r.container_id, r.ord) for r in rows if r.section.startswith("Specific"))
    assert buckets == [
        ("SpecificError", 2, path, 2),
        ("SpecificError", 5, path, 1),
        ("SpecificError", 14, path, 2),
    ]
    spans = {(r.container_id, r.text) for r in rows if r.section == "Keyword"}
    assert spans == {(name, hit) for name, text in texts.items() for hit in machine.spans(text, ["needle"])}


def test_sizes(spark, folder):
    for exclusive in (False, True):
        texts = expected(folder, full=not exclusive)
        spans = [hit for text in texts.values() for hit in machine.spans(text, ["needle"])]
        kept = [] if exclusive else [r for text in texts.values() for _, r in machine.kept(text)]
        run = triage(spark, folder, "needle", exclusive=exclusive)
        got = {r.section: tuple(r)[1:] for r in run.sizes().collect()}
        assert got == {"Keyword": (len(spans), sum(map(len, spans)), 0), "res": (len(kept), sum(map(len, kept)), 0)}


def test_spans_are_withheld_only_over_a_limit_of_the_caller(spark, folder):
    from dataclasses import replace

    run = triage(spark, folder, "needle")
    everything = run.rows().filter("section = 'Keyword'").count()
    size = {r.section: tuple(r) for r in run.sizes().collect()}["Keyword"]
    assert replace(run, max_keyword_chars=size[2]).rows().filter("section = 'Keyword'").count() == everything > 0
    over = replace(run, max_keyword_chars=size[2] - 1)
    assert over.rows().filter("section = 'Keyword'").count() == 0
    assert {r.section: tuple(r) for r in over.sizes().collect()}["Keyword"] == (*size[:3], 1)


def test_texts_have_a_bound_in_every_format(spark, tmp_path):
    (tmp_path / "a").mkdir()
    text = f"{E}one\n" + "\tat a\n" * 20_000
    (tmp_path / "a" / "stderr.gz").write_bytes(gzip.compress(text.encode()))
    size = (tmp_path / "a" / "stderr.gz").stat().st_size
    for limit in (size * 1032, size * 1032 - 1032):
        logs = LogFiles(spark, str(tmp_path), max_text_bytes=limit, rows_per_chunk=5000)
        assert logs.has_large == (limit < size * 1032)
        assert [tuple(r) for r in logs.pieces().select("rec_no", "level", "raw").collect()] == machine.pieces(text)


def test_keyword_only(spark, folder):
    run = triage(spark, folder, "needle", exclusive=True)
    assert {r.section for r in run.rows().collect()} == {"Keyword"}
    assert f"{folder}/short/stderr.gz" in {r.container_id for r in run.rows().collect()}
    assert run.pattern_summary().agg(F.sum("n_records")).first()[0] == 0
    assert {r.reason for r in run.quarantine().collect()} == {"unreadable", "invalid_utf8"}


def test_container_summary_keeps_empty_containers_in_path_order(spark, folder):
    rows = triage(spark, folder).container_summary().collect()
    assert [r.container_id for r in rows] == sorted(expected(folder))
    by_name = {r.container_id[len(folder) + 1 :]: tuple(r)[1:] for r in rows}
    assert by_name["prelude/stderr.gz"] == (0, 0, 0, 0)
    assert by_name["gap/stderr.gz"][:3] == (1, 1, 0)


def test_json_sink(spark, folder, tmp_path):
    import json

    target = tmp_path / "out"
    triage(spark, folder, "needle").write(str(target))
    errors = [json.loads(line) for part in (target / "rows" / "section=ERROR").glob("part-*") for line in part.open()]
    assert all(list(row) == sorted(row) for row in errors)
    texts = expected(folder)
    assert sorted((r["container_id"], r["text"]) for r in errors) == sorted(
        (name, record) for name, text in texts.items() for level, record in machine.kept(text) if level == "ERROR"
    )
    saved = {name: spark.read.json(str(target / name)) for name in ("containers", "patterns", "sizes", "quarantine")}
    assert {r.container_id for r in saved["containers"].collect()} == set(texts)
    assert saved["patterns"].count() == 33 and saved["sizes"].count() == 2
    assert {r.reason for r in saved["quarantine"].collect()} == {"unreadable", "invalid_utf8", "short_header"}


def test_paths(spark):
    assert normalised_path("/a/b/") == "/a/b"
    assert normalised_path("/a/b//") == "/a/b/"
    with pytest.raises(ValueError):
        normalised_path("")
    path = application_path("/logs/", "j-1", "application_1")
    assert path == "/logs/j-1/containers/application_1"
    df = spark.createDataFrame([(path + "/container_1/stderr.gz",), ("/x/stderr.gz",)], "container_id string")
    assert {(r.cluster_id, r.application_id) for r in with_path_columns(df).collect()} == {
        ("j-1", "application_1"),
        (None, None),
    }
