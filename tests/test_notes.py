"""Note rendering and the note sink."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from contentflow.functions import notes as N
from contentflow.functions.dates import utc
from contentflow.operators import note_files as K

AS_OF = "2024-01-31 10:11:12"
DDL = "id string, content string, source string, timestamp timestamp_ntz, metadata map<string,string>, tags array<string>"


def items(spark, *rows):
    base = [(str(i), content, "src", None, meta, tags) for i, (content, meta, tags) in enumerate(rows)]
    return spark.createDataFrame(base, DDL)


def render(spark, options, *rows):
    return [r.content for r in K.render_notes(items(spark, *rows), options, AS_OF).orderBy("id").collect()]


@pytest.mark.parametrize(
    ("title", "name"),
    [("a/b: c", "a_b__c.md"), (" é ü ", "é_ü.md"), ("x😀y", "x_y.md"), ("keep-this_one", "keep-this_one.md"), (None, "None.md"), ("n.md", "n_md.md")],
)
def test_file_names(spark, title, name):
    notes = K.render_notes(items(spark, ("c", {"title": title}, [])), K.NoteOptions(), AS_OF)
    assert notes.first().path == name


def test_untitled_and_templates(spark):
    options = K.NoteOptions(folder="/in/", file_template="{date} {time} {source} {id} {title}.md")
    assert K.render_notes(items(spark, ("c", {}, [])), options, AS_OF).first().path == "in/2024-01-31 10-11-12 src 0 Untitled.md"


def test_front_matter(spark):
    options = K.NoteOptions(tags=["x"], key_order=["title", "url", "missing"])
    meta = {"title": "T", "zeta": "1", "alpha": "2", "url": "u", "gone": None, "tags": "no"}
    head = '---\ntitle: "T"\ndate: 2024-01-31 10:11:12\nsource: src\ntags:\n  - x\n  - own\nurl: u\nalpha: 2\nzeta: 1\n---\n\n'
    assert render(spark, options, ("body", meta, ["own"]), ("---\nown head", meta, None)) == [head + "body", "---\nown head"]
    bare = render(spark, K.NoteOptions(), ("body", {}, None))
    assert bare == ['---\ntitle: "Untitled"\ndate: 2024-01-31 10:11:12\nsource: src\n---\n\nbody']


def test_footer_only_without_front_matter(spark):
    plain = K.NoteOptions(add_frontmatter=False)
    assert render(spark, plain, ("body", {}, []), ("Generated on Monday", {}, [])) == [
        "body\n\n> Generated on 2024-01-31 10:11:12\n\n", "Generated on Monday"
    ]
    assert render(spark, K.NoteOptions(add_frontmatter=False, add_timestamp=False), ("body", {}, [])) == ["body"]


def test_content_template(spark):
    options = K.NoteOptions(add_frontmatter=False, add_timestamp=False, content_template="{title}|{extra}|{content}|{id}")
    got = render(spark, options, ("{title}", {"title": "fixed wins", "extra": None, "content": "no"}, []), ("c", {}, []))
    assert got == ["fixed wins|None|{title}|0", None]  # an unknown field is a failed note
    with pytest.raises(ValueError):
        N.format_template("{nope}", {"title": F.lit("x")})


def notes(spark, *rows):
    df = spark.createDataFrame([(i, i, p, c) for i, p, c in rows], "id string, o string, path string, content string")
    return df.select("id", F.struct("o", "id").alias("place"), "path", "content")


def files(vault):
    return {str(p.relative_to(vault)): p.read_text() for p in Path(vault).rglob("*.md")}


def write(spark, vault, rows, run="run-1", **options):
    done = K.write_notes(spark, notes(spark, *rows), str(vault), K.NoteOptions(**options), run_id=run, as_of=AS_OF)
    return {r.id: (r.ok, r.error) for r in done.collect()}


def test_new_notes_never_touch_existing_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/b.md").write_text("old")
    rows = [("1", "f/a.md", "one"), ("2", "f/a.md", "two"), ("3", "f/a.md", "three"), ("4", "f/b.md", "four"), ("5", "f/c.md", None)]
    for _ in range(2):
        done = write(spark, tmp_path, rows)
    assert files(tmp_path) == {
        "f/a.md": "one", "f/a_20240131101112.md": "two", "f/a_20240131101112_3.md": "three", "f/b.md": "old", "f/b_20240131101112.md": "four",
    }
    assert done["1"] == (True, None) and done["5"] == (False, "template names an unknown field")


def test_runs_under_one_clock_lose_no_note(spark, tmp_path):
    for run in range(4):
        done = write(spark, tmp_path, [(f"{run}", "x.md", f"text {run}")], run=f"run-{run}")
        assert done == {f"{run}": (True, None)}
    assert sorted(files(tmp_path).values()) == [f"text {run}" for run in range(4)]
    # The same id again, when all its names are taken, is reported and nothing is overwritten.
    again = write(spark, tmp_path, [("3", "x.md", "other")], run="run-9")
    assert again == {"3": (False, "every name of the note is taken")}
    assert sorted(files(tmp_path).values()) == [f"text {run}" for run in range(4)]


def test_a_title_like_a_stamped_name_is_a_name_of_its_own(spark, tmp_path):
    rows = [("1", "a.md", "one"), ("2", "a.md", "two"), ("3", "a_20240131101112.md", "three")]
    write(spark, tmp_path, rows)
    assert files(tmp_path) == {"a.md": "one", "a_20240131101112_2.md": "two", "a_20240131101112.md": "three"}


def test_a_run_that_died_before_its_plan_was_whole_can_be_repeated(spark, tmp_path):
    (tmp_path / ".runs/run-1/plan").mkdir(parents=True)
    assert write(spark, tmp_path, [("1", "a.md", "one")]) == {"1": (True, None)}
    assert files(tmp_path) == {"a.md": "one"}
    # A plan without its done row is made anew, whatever it holds.
    notes(spark, ("7", "z.md", "stale")).write.parquet(str(tmp_path / ".runs/run-2/plan"))
    assert write(spark, tmp_path, [("2", "b.md", "two")], run="run-2") == {"2": (True, None)}
    assert files(tmp_path) == {"a.md": "one", "b.md": "two"}


def test_overwrite_keeps_the_last(spark, tmp_path):
    (tmp_path / "a.md").write_text("old")
    done = write(spark, tmp_path, [("1", "a.md", "one"), ("2", "a.md", "two")], mode="overwrite")
    assert files(tmp_path) == {"a.md": "two"} and all(ok for ok, _ in done.values()) and len(done) == 2


@pytest.mark.parametrize(("mode", "expected"), [("append", "öld\n\n{}"), ("prepend", "{}\n\nöld")])
def test_append_and_prepend_keep_order_and_repeat_safely(spark, tmp_path, mode, expected):
    (tmp_path / "hot.md").write_text("öld")
    # One file gets most of the notes: its pieces are written by several tasks.
    rows = [(f"{i:04d}", "hot.md", f"nöte {i}") for i in range(400)] + [(f"x{i}", f"n{i}.md", "alone") for i in range(20)]
    for _ in range(2):
        write(spark, tmp_path, rows, mode=mode)
    pieces = [f"nöte {i}" for i in range(400)]
    joined = "\n\n".join(pieces if mode == "append" else reversed(pieces))
    got = files(tmp_path)
    assert got["hot.md"] == expected.format(joined) and got["n7.md"] == "alone" and len(got) == 21
    segments = {p.name for p in tmp_path.glob(".runs/run-1/segments/*/*") if not p.name.startswith(".")}
    assert len(segments) > 1
    write(spark, tmp_path, [("z", "hot.md", "later")], run="run-2", mode=mode)
    text = files(tmp_path)["hot.md"]
    assert text.endswith("\n\nlater") if mode == "append" else text.startswith("later\n\n")


def test_missing_folder_fails_the_note_only(spark, tmp_path):
    done = write(spark, tmp_path, [("1", "none/a.md", "x"), ("2", "b.md", "y"), ("3", "../c.md", "z")], create_folders=False)
    assert not done["1"][0] and "Cannot create or access directory" in done["1"][1]
    assert done["2"] == (True, None) and files(tmp_path) == {"b.md": "y"} and "leaves the vault" in done["3"][1]


def test_write_paths_of_new_notes_do_not_sort_a_whole_name(spark):
    existing = spark.createDataFrame([], "path string, base_length bigint")
    plan = K.resolve_writes(notes(spark, ("1", "a.md", "x")), existing, K.NoteOptions(), AS_OF)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_stamp_is_a_literal(spark):
    assert spark.range(1).select(N.stamp(utc(AS_OF), "yyyyMMdd").alias("s")).first().s == "20240131"


def test_short_notes_are_written_by_many_tasks(spark, tmp_path):
    """A stored plan of short texts is one file, and one task wrote all notes (6 s for 10,000 of them)."""
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("content"))
    rows.coalesce(1).write.parquet(str(tmp_path / "plan"))
    spread = K.by_number(spark.read.parquet(str(tmp_path / "plan")), "id")
    assert spread.rdd.getNumPartitions() == 8 and spread.count() == 3000
