"""Readers and request parsing on literal rows."""

from pyspark.sql import functions as F

from gristmill.operators import graphs, matching, planning, tables
from gristmill.sources import documents as D
from gristmill.streaming import sync


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_change_feed(spark):
    doc = '{"results":[{"seq":"101-g1","id":"left-pad","changes":[{"rev":"10-abc"}]},{"seq":"102-g1","id":"is-odd","changes":[{"rev":"11-def"}],"deleted":true}],"last_seq":"102-g1"}'
    rows = D.read_change_feed(_df(spark, [(1, doc)], "batch_id int, doc string")).orderBy("pos").collect()
    assert [(r.seq, r.name, r.rev, r.deleted, r.last_seq) for r in rows] == [("101-g1", "left-pad", "10-abc", False, "102-g1"), ("102-g1", "is-odd", "11-def", True, "102-g1")]


def test_requests(spark):
    npm = _df(spark, [("left-pad",), ("@types/node",), ("left-pad@1.0.0",), ("@scope",), ("a b",), ("",)], "line string")
    good, bad = planning.parse_requests(npm, "npm")
    assert sorted(r.name for r in good.collect()) == ["@types/node", "left-pad"]
    assert bad.count() == 4
    go = _df(spark, [("golang.org/x/text",), ("example.com/a@b",), ("example.com/a@b@v1.2.3",)], "line string")
    assert sorted(((r.name, r.version) for r in planning.parse_requests(go, "go")[0].collect()), key=str) == [("example.com/a@b", "v1.2.3"), ("example.com/a@b", None), ("golang.org/x/text", None)]
    maven = _df(spark, [("g:a:1",), ("g:a",), ("g",), ("g:a:",)], "line string")
    assert sorted(((r.name, r.version) for r in planning.parse_requests(maven, "maven")[0].collect()), key=str) == [("g:a", "1"), ("g:a", None)]


def test_escapes_and_paths(spark):
    rows = _df(spark, [("GitHub.com/Google/UUID",), ("V1.2.3-RC1",), ("a!b",), ("é",)], "p string").select(planning.go_escape(F.col("p")).alias("e")).collect()
    assert [r.e for r in rows] == ["!git!hub.com/!google/!u!u!i!d", "!v1.2.3-!r!c1", None, None]
    crates = _df(spark, [("a",), ("ab",), ("abc",), ("Tokio",)], "n string").select(tables.crate_path(F.col("n")).alias("p")).collect()
    assert [r.p for r in crates] == ["1/a", "2/ab", "3/a/abc", "to/ki/tokio"]


def test_crate_features(spark):
    line = '{"name":"anyhow","vers":"1.0.56","features":{"default":["std"],"std":[]},"features2":null,"deps":[{"name":"backtrace","optional":true},{"name":"syn","optional":false}]}'
    other = '{"name":"x","vers":"1","features":{"default":[],"codec":["dep:serde"]},"features2":null,"deps":[{"name":"serde","optional":true},{"name":"chrono","optional":true}]}'
    index = D.read_crate_index(_df(spark, [(line,), (other,)], "line string"))
    features = index["crate_features"].select(F.col("name").alias("pkg"), "feature", "member")
    deps = index["crate_deps"].select(F.col("name").alias("pkg"), "dep", "optional")
    got = {r.pkg: r.features for r in graphs.root_features(features, deps).collect()}
    assert got == {"anyhow": ["backtrace", "default", "std"], "x": ["chrono", "codec", "default"]}


def test_requires_txt_and_metadata(spark):
    text = "base>=1\n# note\n-r other.txt\n\n[x]\nextra-one # why\n[y:python_version<'3']\nextra-two; os_name=='nt'\n[:sys_platform=='win32']\nplain\n"
    got = [r.requirement for r in D.read_requires_txt(_df(spark, [("k", text)], "k string, text string"), ["k"]).orderBy("pos").collect()]
    assert got == ["base>=1", "extra-one; extra == 'x'", "extra-two; os_name=='nt' and extra == 'y' and python_version<'3'", "plain; sys_platform=='win32'"]
    meta = "Metadata-Version: 2.1\nName: rootpkg\nRequires-Dist: depone>=2\n\nRequires-Dist: body\n"
    r = D.read_core_metadata(_df(spark, [("n", "1.0.0", meta)], "name string, version string, text string")).first()
    assert (r.name, r.version, r.requires_dist, r.warnings) == ("rootpkg", "1.0.0", ["depone>=2"], ["missing Version"])


def test_pyproject():
    text = '[project]\ndependencies = ["a>=1"]\n[project.optional-dependencies]\nx = ["b"]\n[tool.poetry.dependencies]\npython = "^3.8"\nc = "^1.2"\nd = {version = "*", optional = true}\n[tool.poetry.extras]\ny = ["d"]\n'
    assert D.pyproject_requirements(text) == ["a>=1", "b; extra == 'x'", "c~=1.2", "d; extra == 'y'"]
    assert D.pyproject_requirements("not toml [") == [] and D.pyproject_requirements(None) == []


def test_inventory_lines(spark):
    text = '# note\ng:a:1\n{"group_id": "g", "artifactId": "b", "version": "2"}\n'
    rows = D.read_inventory(_df(spark, [("f", text)], "source_path string, text string"), "jsonl").orderBy("source_line").collect()
    assert [(r.group_id, r.artifact_id, r.version, r.source_line) for r in rows] == [("g", "a", "1", 2), ("g", "b", "2", 3)]


def test_pip_graph(spark):
    """rootpkg 1.0.0 requires depone>=2; depone 2.1.0 is chosen."""
    req = matching.parse_requirements(_df(spark, [("rootpkg", "depone>=2"), ("rootpkg", "# none"), ("rootpkg", "bad requirement !!")], "root string, requirement string"))
    versions = _df(spark, [("depone", "1.9", False), ("depone", "2.1.0", False), ("depone", "3.0", True)], "name string, version string, yanked boolean")
    rows = matching.candidates_pip(req.select("root", "name", "specifiers"), versions).collect()
    assert [(r.name, r.version, r["rank"]) for r in rows] == [("depone", "2.1.0", 1)]


def test_specifiers(spark):
    cases = [
        ("~=", "1.4.2", "1.4.9", True), ("~=", "1.4.2", "1.5.0", False), ("==", "1.1.*", "1.1.5", True), ("==", "1.1.*", "1.10", False), ("!=", "1.1", "1.1.0", False), ("==", "1.0", "1.0+local", True),
        (">", "1.7", "1.7.post1", False), ("<", "1.0", "1.0rc1", False), (">=", "1.0rc1", "1.0", True), ("===", "1.0", "1.0", True),
    ]
    df = _df(spark, cases, "op string, sv string, version string, want boolean")
    s = F.struct(F.col("op").alias("op"), F.col("sv").alias("version"))
    wrong = df.withColumn("got", matching.specifier_holds(s, F.col("version"))).filter("got <> want OR got IS NULL").collect()
    assert not wrong


def test_readers_survive_junk(spark):
    junk = _df(spark, [("a", None), ("b", ""), ("c", "{"), ("d", "[1]"), ("e", "<x")], "name string, doc string")
    assert D.read_packuments(junk)["deps"].count() == 0
    assert D.read_project_json(junk)["releases"].count() == 0
    xml = junk.select(F.col("name").alias("ga"), F.col("doc").alias("xml"))
    good, bad = D.read_version_metadata(xml)
    assert good.count() == 0 and bad.count() == 5
    assert D.read_crate_index(junk, "doc")["crate_versions"].count() == 0


def test_feed_into_index(spark, tmp_path):
    """Dedupe, skip, delete, restore, missing documents, and no trace of a batch that fails."""
    feed, base, mark = tmp_path / "feed", str(tmp_path / "index"), str(tmp_path / "mark")
    feed.mkdir()

    def page(n, items, last):
        rows = ",".join(f'{{"seq":"{s}","id":"{i}","changes":[{{"rev":"{r}"}}]{",\"deleted\":true" if d else ""}}}' for s, i, r, d in items)
        (feed / f"{n:03d}.json").write_text(f'{{"results":[{rows}],"last_seq":"{last}"}}')

    landed = [("left-pad", None, "{}", None), ("@types/node", None, "{}", None)]
    documents = lambda: spark.createDataFrame(landed, "name string, doc_rev string, doc string, error string")
    run = lambda: sync.follow(spark, str(feed), base, documents, mark).awaitTermination(120)
    index = sync.Index(spark, base)
    page(1, [("1", "left-pad", "1-old", False), ("2", "is-odd", "2-del", True), ("3", "left-pad", "3-new", False), ("4", "@types/node", "3-cached", False), ("5", "ghost", "1-x", False)], "5")
    run()
    packages, tombstones = index.tables()
    assert sorted((r.name, r.rev) for r in packages.collect()) == [("@types/node", "3-cached"), ("left-pad", "3-new")]
    assert sorted((r.name, r.reason) for r in tombstones.collect()) == [("ghost", "packument_not_found"), ("is-odd", "deleted_in_feed")]
    last = index.last()
    assert (last.last_seq, last.input, last.requested, last.updated, last.deleted) == ("5", 5, 4, 2, 2)

    landed.append(("is-odd", None, None, "timeout"))
    page(2, [("6", "@types/node", "3-cached", False), ("7", "is-odd", "4-new", False)], "7")
    try:
        run()
    except Exception as e:
        assert "could not be fetched" in str(e)
    assert index.last().last_seq == "5"

    landed[-1] = ("is-odd", None, "{}", None)
    run()
    packages, tombstones = index.tables()
    assert sorted(r.name for r in packages.collect()) == ["@types/node", "is-odd", "left-pad"]
    assert [r.name for r in tombstones.collect()] == ["ghost"]
    assert (index.last().last_seq, index.last().skipped) == ("7", 1)


def test_index_writes_what_changed(spark, tmp_path):
    """Folders of falling size; the same state as with one snapshot a batch; a batch run twice counts once."""
    index, want = sync.Index(spark, str(tmp_path / "index")), {}
    documents = spark.createDataFrame([(f"p{i}", None, f"doc {i}", None) for i in range(40) if i % 7], "name string, doc_rev string, doc string, error string")
    assert [t.count() for t in index.tables()] == [0, 0]
    batches = [range(20), range(3), [], range(1, 2), range(18, 25), [5], range(40), [39]]
    for n, names in enumerate(batches):
        items = ",".join(f'{{"seq":"{n}","id":"p{i}","changes":[{{"rev":"{n}-{i}"}}]{",\"deleted\":true" if (i + n) % 5 == 0 else ""}}}' for i in names)
        pages = spark.createDataFrame([(f'{{"results":[{items}],"last_seq":"{n}"}}',)], "doc string")
        index.apply(pages, n, documents)
        index.apply(pages, n, documents)
        for i in names:
            gone = "deleted_in_feed" if (i + n) % 5 == 0 else None if i % 7 else "packument_not_found"
            want[f"p{i}"] = f"{n}-{i}", gone
        rows = [f["rows"] for f in index.last()["folders"]]
        assert all(a > b for a, b in zip(rows, rows[1:]))
        assert (index.last()["batch_id"], index.last()["last_seq"]) == (n, str(n) if names else str(n - 1))  # a page without events leaves the token
        packages, tombstones = index.tables()
        assert {r.name: (r.rev, r.doc) for r in packages.collect()} == {k: (r, f"doc {k[1:]}") for k, (r, gone) in want.items() if not gone}
        assert {r.name: (r.rev, r.reason) for r in tombstones.collect()} == {k: v for k, v in want.items() if v[1]}
    before = sorted(map(str, index.changes().collect()))
    index.vacuum(keep=1)
    assert sorted(map(str, index.changes().collect())) == before
    assert sorted(p.name for p in (tmp_path / "index").glob("batch-*")) == sorted(f["path"].rsplit("/", 1)[1] for f in index.last()["folders"])


def test_snapshot_pointer(spark, tmp_path):
    base = str(tmp_path / "s")
    tables.write_snapshot(spark.range(3), base, 1)
    tables.write_snapshot(spark.range(5), base, 2)
    assert tables.read_snapshot(spark, base).count() == 5


def test_repository_files_are_looked_up_by_path(spark, tmp_path):
    from gristmill.operators import tables as T

    rows = spark.createDataFrame([("org.g", "a", "1.0", "<p/>"), ("org.g", "b", "2", "é")], "group_id string, artifact_id string, version string, text string")
    made = T.write_repository(rows, str(tmp_path / "r"))
    (tmp_path / "r/org/g/b/2/b-2.pom").unlink()
    asked = made.select("path").union(spark.createDataFrame([("org/g",), ("no/where",)], "path string"))
    found = {r.path: r.bytes for r in T.repository_files(asked, str(tmp_path / "r")).collect()}
    want = {r.path: r.bytes for r in made.collect() if r.path != "org/g/b/2/b-2.pom"}
    assert found == want and found["org/g/a/1.0/a-1.0.pom"] == 4
