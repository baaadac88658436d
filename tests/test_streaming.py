import gzip
import json

from emberlog.plans.triage import triage
from emberlog.streaming.follow import run_once


def rows_of(folder):
    found = []
    for part in folder.glob("section=*/part-*"):
        for line in part.open():
            row = json.loads(line)
            found.append((part.parent.name.split("=")[1], row.get("pattern_no"), row["container_id"], row["ord"], row["text"]))
    return sorted(found, key=repr)


def test_runs_add_up_to_the_report(spark, tmp_path):
    logs, out, state = (tmp_path / name for name in ("logs", "out", "state"))

    def put(name, text):
        (logs / name).mkdir(parents=True)
        (logs / name / "stderr.gz").write_bytes(gzip.compress(text.encode()))

    put("a", "20/06/06 x ERROR Executor needle\n\tat b\n")
    run_once(spark, str(logs), str(out), str(state), "needle").awaitTermination()
    assert len(rows_of(out)) == 3
    put("b", "20/06/06 x WARN TaskSetManager\n20/06/06 x DEBUG y\n20/06/06 x WARN needle\n")
    put("short", "20/06/06 x\n")
    run_once(spark, str(logs), str(out), str(state), "needle").awaitTermination()
    run_once(spark, str(logs), str(out), str(state), "needle").awaitTermination()
    run = triage(spark, str(logs), "needle")
    report = [tuple(r) for r in run.rows().collect()]
    assert len(report) == 6
    left_out = [("Quarantine", None, r.container_id, 0, r.reason) for r in run.quarantine().collect()]
    assert [r[4] for r in left_out] == ["short_header"]
    assert rows_of(out) == sorted(report + left_out, key=repr)


def test_file_over_the_limit_is_named_and_the_stream_goes_on(spark, tmp_path, monkeypatch):
    from emberlog.streaming import follow

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "stderr.gz").write_bytes(gzip.compress(b"20/06/06 x ERROR y\n"))
    (tmp_path / "logs" / "mystderr.gz").write_bytes(gzip.compress(b"20/06/06 x ERROR long " + bytes(range(65, 91)) * 40))
    small = lambda *args: follow_files(*args, max_text_bytes=60 * 1032)
    follow_files = follow.LogFiles
    monkeypatch.setattr(follow, "LogFiles", small)
    run_once(spark, str(tmp_path / "logs"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = {(section, path.rsplit("/", 1)[1], text) for section, _, path, _, text in rows_of(tmp_path / "out")}
    assert found == {("ERROR", "stderr.gz", "20/06/06 x ERROR y \t  \t "), ("Quarantine", "mystderr.gz", "too_large")}


def test_a_container_delivered_twice_gives_one_entry(spark, tmp_path):
    """Equal lists of a container come once, in one run, in a later one and after a restart; changed lists are added."""
    logs, out, state = (tmp_path / name for name in ("logs", "out", "state"))

    def put(day, name, text):
        (logs / day / name).mkdir(parents=True)
        (logs / day / name / "stderr.gz").write_bytes(gzip.compress(text.encode()))

    def run():
        run_once(spark, str(logs), str(out), str(state), "needle", identity="container_[0-9]+").awaitTermination()
        return sorted((row[0], row[2], row[4]) for row in rows_of(out) if row[0] in ("ERROR", "WARN", "Keyword", "Quarantine"))

    first = "20/06/06 x ERROR Executor needle\n20/06/06 x INFO one\n20/06/06 x WARN y"
    put("monday", "container_1", first)
    put("tuesday", "container_1", first)
    put("tuesday", "container_2", first)
    one = run()
    assert [(s, c) for s, c, _ in one] == [(s, c) for s in ("ERROR", "Keyword", "WARN") for c in ("container_1", "container_2")]
    put("wednesday", "container_1", first)
    put("thursday", "container_2", first.replace("INFO one", "INFO other"))  # a record that is in no list
    assert run() == one
    put("friday", "container_1", first + " changed")
    put("friday", "container_3", "20/06/06 x\n")
    put("saturday", "container_3", "20/06/06 x\n")
    more = run()
    assert [(s, c) for s, c, _ in more if (s, c, _) not in one] == [("Quarantine", "container_3"), ("WARN", "container_1")]
    assert len(more) == len(one) + 4  # the other two lists of the changed entry come again with it
