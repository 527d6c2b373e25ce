import subprocess

import pytest
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.plans.ingest import ingest
from corpusloom.sources import files as source_files
from corpusloom.sources.chunk_store import ChunkStore
from corpusloom.sources.embedding_cache import EmbeddingCache
from corpusloom.functions.vectors import mock_embedding
from corpusloom.functions.ids import cache_key

SETTINGS = Settings(dense_dim=8, ignore_globs={"ns": ("manual/drafts/**", "**/old.md")})


def git(root, *args):
    identity = ["-c", "user.email=t@example.org", "-c", "user.name=t", "-c", "commit.gpgsign=false"]
    return subprocess.run(["git", *identity, *args], cwd=root, check=True, capture_output=True, text=True).stdout


def commit_all(root, message="c"):
    git(root, "add", "-A")
    git(root, "commit", "-q", "-m", message)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    (root / "manual" / "drafts").mkdir(parents=True)
    (root / "pkg").mkdir()
    (root / "manual" / "intro.rst").write_text("Intro\n=====\nfirst\n\nDepth\n-----\nsecond\n")
    (root / "manual" / "drafts" / "plan.txt").write_text("later\n")
    (root / "manual" / "old.md").write_text("# no\n")
    (root / "pkg" / "__init__.py").write_text("def boot():\n    return 1\n")
    (root / "pkg" / "data.bin").write_bytes(b"\0\1")
    (root / "readme.md").write_text("# Title\ntext\n")
    git(root, "init", "-q", "-b", "main")
    commit_all(root)
    return root


def live(store, *columns):
    return sorted(tuple(r) for r in store.read("ns").select(*columns).collect())


def run(spark, tree, store, **kw):
    return ingest(spark, "ns", str(tree), store, settings=SETTINGS, **kw)


def test_sync_life_cycle(spark, tree, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    first = run(spark, tree, store)
    assert (first.files_seen, first.files_indexed, first.chunks_written) == (3, 3, 4)
    assert live(store, "file_path", "symbol", "chunk_type") == [
        ("manual/intro.rst", "Depth", "doc"), ("manual/intro.rst", "Intro", "doc"),
        ("pkg/__init__.py", "boot", "code"), ("readme.md", "Title", "doc"),
    ]
    row = store.read("ns").where("symbol = 'Depth'").first()
    assert (row["heading_path"], row["level"], row["language"], len(row["embedding"])) == ("Intro > Depth", 2, None, 8)

    again = run(spark, tree, store)
    assert (again.files_indexed, again.files_skipped_unchanged, again.chunks_written) == (0, 3, 0)
    assert len(store.commits()) == 1

    (tree / "readme.md").write_text("# Title\nnew text\n# Second\n")
    (tree / "manual" / "intro.rst").unlink()
    (tree / "new.txt").write_text("plain")
    commit_all(tree)
    (tree / "untracked.md").write_text("# later\n")
    change = run(spark, tree, store)
    assert (change.files_seen, change.files_indexed, change.files_deleted) == (3, 2, 1)
    assert change.files_skipped_unchanged == 1
    assert live(store, "file_path", "symbol") == [
        ("new.txt", "new"), ("pkg/__init__.py", "boot"), ("readme.md", "Second"), ("readme.md", "Title"),
    ]

    forced = run(spark, tree, store, force_reindex=True)
    assert (forced.files_indexed, forced.files_skipped_unchanged) == (3, 0)
    before = live(store, "doc_id", "file_path", "text")
    store.compact()
    assert live(store, "doc_id", "file_path", "text") == before
    assert len(store.commits()) == 1
    assert run(spark, tree, store).chunks_written == 0


def test_deletion_only_and_subtree(spark, tree, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    part = ingest(spark, "ns", str(tree / "manual"), store, repo_root=str(tree), settings=SETTINGS)
    assert (part.files_seen, part.files_indexed) == (1, 1)
    assert {f for (f,) in live(store, "file_path")} == {"manual/intro.rst"}
    (tree / "manual" / "intro.rst").unlink()
    commit_all(tree)
    gone = ingest(spark, "ns", str(tree / "manual"), store, repo_root=str(tree), settings=SETTINGS, allow_empty=True)
    assert (gone.files_seen, gone.files_deleted, gone.chunks_written) == (0, 1, 0)
    assert live(store, "file_path") == [] and store.file_shas("ns").count() == 0
    whole = run(spark, tree, store)
    assert (whole.files_indexed, whole.files_deleted) == (2, 0)
    assert {f for (f,) in live(store, "file_path")} == {"pkg/__init__.py", "readme.md"}


def test_links_resolve_and_stay_inside(spark, tree, tmp_path):
    outside = tmp_path / "outside.md"
    outside.write_text("# Out\n")
    (tree / "link.md").symlink_to(outside)
    (tree / "same.md").symlink_to(tree / "readme.md")
    files = source_files.relative_files(spark, str(tree), str(tree), (".md",))
    assert sorted(r["path"] for r in files.collect()) == ["manual/old.md", "readme.md"]


def test_smoke_file_touches_nothing_else(spark, tree, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    report = run(spark, tree, store, smoke_file="readme.md")
    assert (report.files_seen, report.files_indexed) == (1, 1)
    assert live(store, "file_path") == [("readme.md",)]


def test_shas_equal_git(spark, tree):
    (tree / "readme.md").write_text("# Title\nx\n")
    commit_all(tree)
    got = {r[0]: r[1] for r in source_files.git_shas(spark, str(tree)).collect()}
    for path in git(tree, "ls-files").split():
        assert got[path] == git(tree, "log", "-1", "--format=%H", "--", path).strip()


def test_dry_run_ignores_globs_and_history(spark, tree, tmp_path):
    (tree / "untracked.md").write_text("# later\n")
    report = ingest(spark, "ns", str(tree), dry_run=True, settings=SETTINGS)
    assert (report.files_seen, report.files_indexed, report.chunks_written) == (6, 6, 7)
    missing = ingest(spark, "ns", str(tmp_path / "none"), dry_run=True)
    assert (missing.files_seen, missing.errors) == (0, [])


def test_failed_update_keeps_old_chunks(spark, tree, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    run(spark, tree, store, change_key="content")
    (tree / "readme.md").write_text("# Other\n")
    real = source_files._read

    def broken(frames):
        for frame in real(frames):
            bad = frame["path"] == "readme.md"
            frame.loc[bad, "text"] = None
            frame.loc[bad, "error"] = "readme.md: unreadable"
            yield frame

    files = store.file_shas("ns")
    assert files.count() == 3
    import corpusloom.plans.ingest as plan

    original = plan.read_files
    plan.read_files = lambda f: f.mapInPandas(
        broken, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in f.schema) + ", text string, error string"
    ) if "commit_sha" in f.columns else original(f)
    try:
        report = run(spark, tree, store, change_key="content")
    finally:
        plan.read_files = original
    assert (report.error_count, report.errors) == (1, ["readme.md: unreadable"])
    assert ("readme.md", "Title") in live(store, "file_path", "symbol")


def test_upsert_and_delete(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    assert not store.exists() and store.count() == 0
    schema = "doc_id string, namespace string, file_path string, commit_sha string, text string"
    rows = [("1", "ns", "a", "s", "one"), ("2", "ns", "a", "s", "two"), ("3", "other", "a", "s", "three")]
    store.upsert(spark.createDataFrame(rows, schema))
    store.upsert(spark.createDataFrame([("2", "ns", "a", "s2", "TWO"), ("4", "ns", "b", "s2", "")], schema))
    assert store.upsert(spark.createDataFrame([], schema)) is None
    assert live(store, "doc_id", "text") == [("1", "one"), ("2", "TWO"), ("4", "")]
    assert sorted(r[0] for r in store.texts("ns").select("doc_id").collect()) == ["1", "2"]
    assert {r[0]: r[1] for r in store.file_shas("ns").collect()} == {"a": "s", "b": "s2"}
    store.delete_files(spark.createDataFrame([("ns", "a")], "namespace string, file_path string"))
    assert live(store, "doc_id") == [("4",)]
    assert store.count("other") == 1 and store.count() == 2


def test_uncommitted_generation_is_invisible(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    schema = "doc_id string, namespace string, file_path string, commit_sha string, text string"
    points = spark.createDataFrame([("1", "ns", "a", "s", "one")], schema)
    store.upsert(points)

    def lost(_):
        raise RuntimeError("executor lost")

    bad = store.read("ns").withColumn("doc_id", F.lit("9")).withColumn("error", F.lit(None).cast("string"))
    with pytest.raises(RuntimeError, match="lost"):
        store.apply(bad, after_write=lost)
    assert live(store, "doc_id") == [("1",)]
    store.upsert(spark.createDataFrame([("2", "ns", "a", "s", "two")], schema))
    assert live(store, "doc_id") == [("1",), ("2",)]


def test_embedding_cache(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path), "org/model-x")

    def embed(column):
        return mock_embedding(column, 8)

    chunks = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "a")], "doc_id string, text string")
    got = {r["doc_id"]: r["embedding"] for r in cache.embed(chunks, embed).collect()}
    assert got["1"] == got["3"] != got["2"]
    assert cache.read().count() == 2
    more = spark.createDataFrame([("4", "b"), ("5", "c")], "doc_id string, text string")
    assert cache.embed(more, embed).where("embedding is not null").count() == 2
    assert cache.read().count() == 3
    keys = {r[0] for r in more.select(cache_key(F.col("text"), "org/model-x")).collect()}
    assert keys <= {r[0] for r in cache.read().select("cache_key").collect()}
