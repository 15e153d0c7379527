"""Report folders read after two listings, with a log of what was skipped."""

import json

from tidemark.catalog.scans import write_each
from tidemark.sources import reports as S

GOOD = '{"ArtifactName": "%s", "Results": [{"Vulnerabilities": [{"VulnerabilityID": "C-1"}, {"VulnerabilityID": "C-1"}]}]}'


def names(rows):
    return sorted((r["file"].split("/")[-1], r["reason"]) for r in rows)


def test_outcome_of_each_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in [("good.json", GOOD % "a"), ("other file.json", GOOD % "b"), ("empty.json", ""), ("blank.json", " \n\t"), ("cut.json", GOOD[:30]), ("grows.json", GOOD[:50]), ("gone.json", GOOD % "c"), ("note.txt", "{}")]:
        (folder / name).write_text(text)
    before = S.list_files(spark, str(folder))
    (folder / "grows.json").write_text(GOOD % "d")
    (folder / "new.json").write_text(GOOD % "e")
    (folder / "gone.json").unlink()
    listed = S.compare_listings(before, S.list_files(spark, str(folder)))
    good, skipped = S.read_listed(spark, str(folder), listed, str(tmp_path / "log"))
    assert sorted((r["ArtifactName"], r["file"].split("/")[-1]) for r in good.collect()) == [("a", "good.json"), ("b", "other%20file.json")]
    want = [("blank.json", "empty"), ("cut.json", "broken"), ("empty.json", "empty"), ("gone.json", "gone"), ("grows.json", "growing"), ("new.json", "growing")]
    assert names(skipped.collect()) == want
    assert names(spark.read.json(str(tmp_path / "log")).collect()) == want
    assert [r["text"] for r in skipped.collect() if r["reason"] == "broken"] == [GOOD[:30]]
    # the next cycle reads what has settled, and adds to the log
    good, skipped = S.read_settled_reports(spark, str(folder), 0.05, str(tmp_path / "log"))
    assert sorted(r["ArtifactName"] for r in good.collect()) == ["a", "b", "d", "e"]
    assert spark.read.json(str(tmp_path / "log")).count() == len(want) + 3
    assert json.loads(good.toJSON().first())["Results"][0]["Vulnerabilities"][0]["VulnerabilityID"] == "C-1"


def test_a_file_that_changes_after_the_listings_waits(spark, tmp_path):
    (tmp_path / "a.json").write_text(GOOD % "a")
    listed = S.compare_listings(S.list_files(spark, str(tmp_path)), S.list_files(spark, str(tmp_path)))
    (tmp_path / "a.json").write_text(GOOD % "longer")
    good, skipped = S.read_listed(spark, str(tmp_path), listed)
    assert good.count() == 0 and names(skipped.collect()) == [("a.json", "growing")]


def test_empty_folder(spark, tmp_path):
    good, skipped = S.read_settled_reports(spark, str(tmp_path), 0)
    assert good.count() == 0 and skipped.count() == 0


def test_reports_are_written_by_many_tasks(spark, tmp_path):
    for n in (0, 1, 3, 200):
        rows = spark.range(n).coalesce(1).selectExpr("concat('row ', id) AS value")
        write_each(rows, str(tmp_path / str(n)))
        files = list((tmp_path / str(n)).glob("*.txt"))
        assert sorted(f.read_text().strip() for f in files if f.stat().st_size) == sorted(f"row {i}" for i in range(n))
        assert sum(not f.stat().st_size for f in files) == (n == 0)
    assert len({f.name.split("-")[1] for f in files}) > 1
