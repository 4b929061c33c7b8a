import gzip
import hashlib
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from evisift.operators import curation, resolve
from evisift.plans import build
from evisift.sources import blocks, jsonl, ontology, sinks, snapshot, tabular, xmlscan


def uri(code):
    return "http://purl.obolibrary.org/obo/" + code.replace(":", "_")


@pytest.fixture
def graph_file(tmp_path):
    def node(code, label, meta=None):
        return {"id": uri(code), "type": "CLASS", "lbl": label, "meta": meta or {}}

    nodes = [node("HP:0000118", "Root"), node("HP:8123401", "Sign 1", {
        "synonyms": [{"pred": "hasExactSynonym", "val": "Alias"}],
        "basicPropertyValues": [{"pred": "oboInOwl#hasAlternativeId", "val": "HP:8765401"}],
        "xrefs": [{"val": "Orphanet:77"}, {"val": "MESH:D000001"}]}),
        node("HP:8123402", "Sign 2"),
        node("HP:8765498", "Old", {"deprecated": True, "basicPropertyValues": [{"pred": uri("IAO:0100001"), "val": uri("HP:8123401")}]}),
        node("HP:8765499", "Retired", {"deprecated": True}), {"id": uri("HP:1"), "type": "PROPERTY"}]
    edges = [{"sub": uri("HP:8123401"), "pred": "is_a", "obj": uri("HP:0000118")},
             {"sub": uri("HP:8123402"), "pred": "is_a", "obj": uri("MONDO:1")},
             {"sub": uri("HP:8123402"), "pred": "is_a", "obj": uri("HP:6543217")}]
    path = tmp_path / "hp.json"
    path.write_text(json.dumps({"graphs": [{"nodes": nodes, "edges": edges}]}, indent=1))
    return str(path)


def test_ontology(spark, graph_file):
    got = ontology.scan(spark, graph_file, prefix="HP:", kind="phenotype", release="hp:1")
    assert got.concept.count() == 5 and got.concept.filter("obsolete").count() == 2
    assert {(r["text"], r["scope"]) for r in got.term.filter("text LIKE 'A%'").collect()} == {("Alias", "hasExactSynonym")}
    assert {r["identifier"] for r in got.identifier.filter("relation = 'alternative'").collect()} == {"HP:8765401"}
    assert [tuple(r) for r in got.replaced_by.collect()] == [("HP:8765498", "HP:8123401")]
    assert {(r["target"], r["relation"]) for r in got.mapping.collect()} == {("ORPHA:77", "xref"), ("HP:8123401", "replaced_by")}
    assert got.edge.count() == 1
    assert [tuple(r) for r in got.unresolved_edge.collect()] == [("HP:8123402", "HP:6543217")]
    outcome = resolve.resolve_obsolete(
        got.concept.select(F.col("external_id").alias("concept_id"), "obsolete"),
        got.replaced_by.toDF("concept_id", "replacement"),
    )
    by = {r["concept_id"]: (r["resolved"], r["outcome"]) for r in outcome.collect()}
    assert by["HP:8765498"] == ("HP:8123401", "replaced") and by["HP:8765499"] == (None, "retired")
    known = got.concept.select("concept_id", F.col("external_id").alias("primary_code"))
    identifiers, mappings = ontology.scan_xrefs(spark, graph_file, known, "x:1")
    assert {r["code"] for r in identifiers.collect()} == {"ORPHA:77", "MESH:D000001"}
    assert [(r["target_code"], r["relation"]) for r in mappings.collect()] == [("MESH:D000001", "unresolved")]


def test_replacement_cycles_and_ambiguity(spark):
    concepts = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False), ("e", True)], "concept_id string, obsolete boolean")
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("c", "x"), ("e", "zz")], "concept_id string, replacement string")
    got = {r["concept_id"]: r["outcome"] for r in resolve.resolve_obsolete(concepts, links).collect()}
    assert got == {"a": "cycle", "b": "cycle", "c": "ambiguous", "d": "active", "e": "unknown"}


def test_associations_and_projection(spark, tmp_path, graph_file):
    for lang in ("en", "fr"):
        body = "".join(
            f'<Disorder id="{i}"><OrphaCode>{code}</OrphaCode><Name lang="{lang}">{lang} name {code}</Name><ExpertLink>http://x</ExpertLink>'
            f'<HPODisorderAssociationList count="1"><HPODisorderAssociation id="{i}"><HPO id="1"><HPOId>HP:812340{i}</HPOId>'
            f'<HPOTerm>{lang} term</HPOTerm></HPO>{freq}</HPODisorderAssociation></HPODisorderAssociationList></Disorder>'
            for i, (code, freq) in enumerate([("900001", '<HPOFrequency id="28412"><Name>often</Name></HPOFrequency>'),
                                              ("900002", '<HPOFrequency id="28440"><Name>never</Name></HPOFrequency>')], 1)
        )
        (tmp_path / f"{lang}.xml").write_text(f"<?xml version='1.0' encoding='UTF-8'?><JDBOR><DisorderList>{body}</DisorderList></JDBOR>")
    rows = [
        xmlscan.scan_associations(spark, str(tmp_path / f"{lang}.xml"), source="orpha", release="orpha:1", language=lang)
        for lang in ("en", "fr")
    ]
    both = rows[0].unionByName(rows[1])
    got = {r["record_id"]: r for r in rows[0].collect()}
    assert got["1"]["subject_label"] == "en name 900001" and got["1"]["frequency"]["lower"] == 0.8
    assert got["2"]["polarity"] == "excluded"
    assert xmlscan.association_problems(both).count() == 0
    merged, conflicts = resolve.merge_bilingual(
        both.select("record_id", "language", "subject_code", "finding_code", "polarity", "frequency",
                    F.concat_ws(":", "language", "subject_label").alias("provenance"))
    )
    assert conflicts.count() == 0 and {tuple(r["languages"]) for r in merged.collect()} == {("en", "fr")}
    assert resolve.language_gaps(rows[0].unionByName(rows[1].filter("record_id = '1'")), 2).count() == 1
    onto = ontology.scan(spark, graph_file, prefix="HP:", kind="phenotype", release="hp:1")
    assertion = merged.join(onto.concept.select(F.col("external_id").alias("finding_code"), F.col("concept_id").alias("finding")), "finding_code").select(
        F.col("subject_code").alias("subject"), "finding", F.lit("orpha").alias("source"), F.lit("1").alias("release_name"),
        F.array(F.lit("aa"), F.lit("bb")).alias("artifact_hashes"), "record_id", "polarity", "frequency",
    )
    tables = build.project_simple_tables({
        "concept": onto.concept, "term": onto.term, "identifier": onto.identifier, "edge": onto.edge,
        "mapping": onto.mapping, "assertion": assertion,
    })
    assert tables["canonical_assertion"].count() == 2 and tables["evidence_family"].count() == 2
    assert {r["kind"] for r in tables["concept"].collect()} == {"finding"}
    build.register_views(tables)
    assert spark.sql("SELECT count(*) FROM source_assertion JOIN assertion_derivation USING (source_id)").first()[0] == 2
    assert spark.sql("SELECT count(*) FROM ancestor").first()[0] == 3


def test_descriptors_gzip(spark, tmp_path):
    def record(ui, name, numbers):
        trees = "".join(f"<TreeNumber>{n}</TreeNumber>" for n in numbers)
        return (f"<DescriptorRecord><DescriptorUI>{ui}</DescriptorUI><DescriptorName><String>{name}</String></DescriptorName>"
                f"<TreeNumberList>{trees}</TreeNumberList><ConceptList><Concept><TermList><Term><String>Zeta</String></Term>"
                f"<Term><String>{name}</String></Term><Term><String>alpha</String></Term></TermList></Concept></ConceptList></DescriptorRecord>")

    text = "<DescriptorRecordSet>" + record("D1", "Parent", ["C01"]) + record("D2", "Child", ["C01.100", "C02.5"]) + "</DescriptorRecordSet>"
    path = tmp_path / "desc.xml.gz"
    path.write_bytes(gzip.compress(text.encode()))
    got = xmlscan.scan_descriptors(spark, str(path))
    assert {r["descriptor"]: r["terms"] for r in got.collect()} == {"D1": ["Parent", "alpha", "Zeta"], "D2": ["Child", "alpha", "Zeta"]}
    tables = xmlscan.descriptor_tables(got, "mesh:1")
    assert tables["edge"].count() == 1 and tables["designation"].filter("scope = 'preferred'").count() == 2


def test_topics_plain_and_zip(spark, tmp_path):
    text = ('<health-topics total="1"><health-topic id="5" title="Cold" language="English" url="http://t" date-created="01/01/2020">'
            "<also-called>Common cold</also-called><full-summary>&lt;p&gt;Fever.&lt;/p&gt;</full-summary><group id='1'>G</group>"
            '<mesh-heading><descriptor id="D003139">Common Cold</descriptor></mesh-heading>'
            '<related-topic id="6" url="http://r">Flu</related-topic><site title="S" url="http://s"><organization>O</organization></site>'
            '<site title="no url"><organization>O</organization></site></health-topic></health-topics>')
    (tmp_path / "t.xml").write_text(text)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.xml", text)
    a = xmlscan.scan_topics(spark, str(tmp_path / "t.xml")).collect()
    b = xmlscan.scan_topics(spark, str(tmp_path / "t.zip")).collect()
    assert a == b and len(a) == 1
    r = a[0]
    assert (r["topic_id"], r["synonyms"], r["summaries"]) == ("5", ["Common cold"], ["<p>Fever.</p>"])
    assert r["headings"][0]["descriptor_id"] == "D003139" and r["related"][0]["title"] == "Flu" and len(r["links"]) == 1
    assert xmlscan.topic_problems(xmlscan.scan_topics(spark, str(tmp_path / "t.xml"))).count() == 0


def test_graph_edges(spark, tmp_path):
    header = ("id\tpredicate\tcategory\tsubject\tobject\tprimary_knowledge_source\taggregator_knowledge_source\tfile_source\t"
              "negated\thas_count\thas_total\thas_percentage\tonset_qualifier")
    good = "biolink:has_phenotype\tbiolink:DiseaseToPhenotypicFeatureAssociation"
    lines = [header, f"e1\t{good}\tM:1\tHP:1\tinfores:omim\tagg\tf\tFalse\t3\t7\t\tearly",
             f"e2\t{good}\tM:1\tHP:2\tinfores:orphanet\tagg\tf\tTrue\t\t\t\t", f"e3\t{good}\tM:9\tHP:1\tx\tagg\tf\t\t\t\t\t",
             "e4\tbiolink:other\tx\tM:1\tHP:1\tx\tagg\tf\t\t\t\t\t"]
    data = "\n".join(lines).encode()
    with tarfile.open(tmp_path / "kg.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("edges.tsv")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    subjects = spark.createDataFrame([("M:1", "s1")], "code string, concept_id string")
    findings = spark.createDataFrame([("HP:1", "f1"), ("HP:2", "f2")], "code string, concept_id string")
    edges = tabular.scan_graph_edges(spark, str(tmp_path / "kg.tar.gz"), member="edges.tsv", subjects=subjects, findings=findings)
    got = {r["edge_id"]: r for r in edges.collect()}
    assert set(got) == {"e1", "e2"}
    assert got["e1"]["frequency"]["raw"] == "3/7" and got["e2"]["frequency"]["kind"] == "excluded"
    assert got["e1"]["source_locator"] == "edges.tsv:row=2:id=e1"
    rows = tabular.graph_assertions(edges, subjects, findings, source="kg", release="1", artifact_sha256="aa",
                                    shared={"infores:orphanet": "shared-family"})
    by = {r["finding"]: r for r in rows.collect()}
    assert by["f2"]["family"] == "shared-family" and by["f2"]["polarity"] == "excluded"
    assert by["f1"]["dependency_type"] == "derived_from"
    with pytest.raises(Exception):
        blocks.member_lines(spark, str(tmp_path / "kg.tar.gz"), member="none.tsv").count()


@pytest.mark.parametrize("name", ["a.txt.gz", "a.zip", "a.tar.gz"])
def test_members_come_in_batches_of_lines(spark, tmp_path, name):
    """About 60 MB of lines unpacked as a stream: no batch holds more than 7000 of them."""
    lines = [f"{i} {'é' * (i % 300)}" for i in range(200_000)]
    data = "\r\n".join(lines).encode()
    path = tmp_path / name
    if name.endswith("zip"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("m.txt", data)
    elif name.endswith("tar.gz"):
        with tarfile.open(path, "w:gz", compresslevel=1) as t:
            for member, body in (("other", b"x" * 5000), ("m.txt", data)):
                info = tarfile.TarInfo(member)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
    else:
        path.write_bytes(gzip.compress(data, 1))
    got = blocks.member_lines(spark, str(path), member="m.txt" if "tar" in name else None, suffix=".txt", batch=7000)
    assert got.agg(F.count("value"), F.sum("ordinal"), F.sum(F.length("value"))).first()[:] == (200_000, 200_000 * 200_001 // 2, sum(map(len, lines)))
    sizes = [len(b) for b in blocks.MemberReader({"path": str(path), "member": "m.txt", "suffix": ".txt", "batch": "7000"}).read(blocks.FilePart(str(path)))]
    assert max(sizes) == 7000 and len(sizes) == 29


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_json_elements_from_byte_ranges(spark, tmp_path, block):
    """Brackets and quotes inside strings, runs of backslashes and elements over many ranges."""
    odd = ["{[", 'a"b', "\\", '\\"', "}]", "é😀", "\\\\", ""]
    inner = [{"id": f"n{i}", "lbl": odd[i % len(odd)] * (i % 3 + 1), "meta": {"x": [{"y": odd[(i * 3) % len(odd)]}]}} for i in range(12)]
    document = {"graphs": [{"meta": {"note": "{\"graphs\": ["}, "nodes": inner, "edges": [{"sub": "a", "obj": "}"}]}, {"nodes": inner[:2], "edges": []}]}
    for form in ({"indent": 1}, {"ensure_ascii": False, "separators": (",", ":")}):
        path = tmp_path / f"{len(form)}.json"
        path.write_text(json.dumps(document, **form))
        if block == 1 and len(form) == 1:
            continue  # the same again in many more ranges
        got = sorted(r["value"] for r in blocks.json_elements(spark, str(path), 5, block=max(block, 3)).collect())
        assert sorted(map(json.dumps, map(json.loads, got))) == sorted(map(json.dumps, [*inner, *inner[:2], {"sub": "a", "obj": "}"}]))
    with pytest.raises(ValueError):
        (tmp_path / "cut.json").write_text('{"graphs": [{"nodes": [{"id": 1}')
        blocks.json_elements(spark, str(tmp_path / "cut.json"), 5)


def test_rf2(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("id\tactive\n1\t1\n2\t1\n3\t0\n4\t1\n5\t1\n")
    (tmp_path / "d.tsv").write_text(
        "id\tactive\tconceptId\tlanguageCode\ttypeId\tterm\nd1\t1\t1\ten\tFSN\tCold (disorder)\nd2\t1\t2\ten\tFSN\tFever (finding)\n"
        "d3\t1\t1\ten\tSYN\tthe \"cold\nd4\t0\t4\ten\tFSN\tGone (finding)\nd5\t1\t5\ten\tFSN\tOdd (procedure)\n")
    (tmp_path / "r.tsv").write_text("id\tactive\tsourceId\tdestinationId\ttypeId\nr1\t1\t2\t1\tISA\nr2\t1\t2\t3\tISA\nr3\t0\t1\t2\tISA\n")
    got = tabular.scan_rf2(spark, *[str(tmp_path / f"{n}.tsv") for n in "cdr"], system="http://s", release="rf:1",
                           fsn_type="FSN", is_a_type="ISA")
    assert {(r["primary_code"], r["kind"]) for r in got["concept"].collect()} == {("1", "condition"), ("2", "finding")}
    assert got["edge"].count() == 1 and got["designation"].count() == 3
    assert {tuple(r) for r in got["problem"].collect()} == {("4", "missing_name"), ("5", "unsupported_kind"), ("r2", "edge_outside_subset")}


def test_curated_lines(spark, tmp_path):
    def line(i, code):
        return json.dumps({"record_id": i, "record_locator": f"l{i}", "subject": {"system": "s", "code": "A"}, "relation": "has_sign",
                           "object": {"system": "s", "code": code}, "polarity": "present"})

    (tmp_path / "a.jsonl").write_text("\n".join([line("1", "B"), line("2", "ZZ"), line("3", "B"), line("3", "B")]))
    codes = spark.createDataFrame([("s", "A", "ca"), ("s", "B", "cb")], "system string, code string, concept_id string")
    rows, problems = jsonl.scan_curated(spark, str(tmp_path / "a.jsonl"), codes, source="c", release="1", artifact_sha256="aa")
    assert {tuple(r) for r in problems.collect()} == {("2", "unknown_code"), ("3", "duplicate_record")}
    assert {(r["subject"], r["finding"]) for r in rows.collect()} == {("ca", "cb")}


def test_cases_and_lexicon(spark, tmp_path):
    (tmp_path / "cases").mkdir()
    (tmp_path / "cases/a.json").write_text(json.dumps({"case_id": "a", "observations": [{"concept_id": "HP:0000001", "status": "present"}]}))
    (tmp_path / "cases/b.json").write_text(json.dumps({"case_id": "b", "schema_version": 2, "observations": [
        {"kind": "symptom", "observation_id": "o", "concept": {"concept_id": "c", "coding": {"system": "s", "code": "x"}}, "clinical_status": "present"}]}))
    (tmp_path / "cases/c.json").write_text(json.dumps({"case_id": "c", "schema_version": 7}))
    v1, v2, other = jsonl.read_cases(spark, str(tmp_path / "cases"))
    assert [r["case_id"] for r in v1.collect()] == ["a"] and [r["case_id"] for r in v2.collect()] == ["b"]
    assert [r["case_id"] for r in other.collect()] == ["c"]
    per = {l: "x" for l in jsonl.LANGUAGES}
    entry = {"code": "HP:1", "labels": per, "aliases": {l: ["y", "z"] for l in jsonl.LANGUAGES}, "questions": per}
    (tmp_path / "lex.json").write_text(json.dumps({"version": "1", "entries": [entry]}))
    assert jsonl.read_lexicon(spark, str(tmp_path / "lex.json")).count() == 9


def test_snapshot_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(f"id{i}", i) for i in range(50)], "id string, n int")
    snapshot.write_tables({"t": df}, str(tmp_path / "snap"), {"t": "id"})
    digest = snapshot.table_hash(df.repartition(7)).first()
    assert digest["rows"] == 50
    back = snapshot.read_tables(spark, str(tmp_path / "snap"), {"t": "id string, n int"}, {"t": digest["logical_sha256"]})
    assert snapshot.rebuild_differences(back["t"], df).count() == 0
    with pytest.raises(ValueError):
        snapshot.read_tables(spark, str(tmp_path / "snap"), {"t": "id string, n int"}, {"t": "0"})
    with pytest.raises(Exception):
        snapshot.write_tables({"t": df}, str(tmp_path / "snap"), {"t": "id"})
    changed = snapshot.table_hash(df.withColumn("n", F.col("n") + 1)).first()
    assert changed["logical_sha256"] != digest["logical_sha256"]


def test_checksums_and_guard(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.txt").write_text("a")
    expected = spark.createDataFrame(
        [("a.txt", hashlib.sha256(b"a").hexdigest()), ("b.txt", "0")], "name string, sha256 string"
    )
    assert [tuple(r) for r in snapshot.checksum_violations(snapshot.file_hashes(spark, str(tmp_path / "f")), expected).collect()] == [("b.txt", "missing")]
    df = spark.createDataFrame([("=1+1",), (" @x",), ("ok",)], "t string")
    sinks.write_review_csv(df, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()) == ["' @x", "'=1+1", "ok"]
    cands = spark.createDataFrame([("b",), ("a",)], "candidate_assertion_id string")
    jsonl.write_candidates(cands, str(tmp_path / "cand"))
    assert jsonl.read_candidates(spark, str(tmp_path / "cand")).count() == 2
    rows = spark.createDataFrame([("allowed_with_attribution",), ("restricted",)], "redistribution string")
    assert snapshot.most_restrictive(rows).first()[0] == "restricted"


def package(spark, tmp_path, reviewed=True, pairs=2):
    folder = tmp_path / f"pkg{reviewed}{pairs}"
    folder.mkdir()
    code = lambda c: {"system": "s", "code": c}
    segments = {"segments": [{"segment_id": "g1", "artifact_id": "art", "locator": "p1", "text": "words"}]}
    seg_text = json.dumps(segments)
    (folder / "segments.json").write_text(seg_text)
    (folder / "art.txt").write_text("art")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    (folder / "manifest.json").write_text(json.dumps({
        "package_id": "p", "status": "approved_for_snapshot", "candidate_codes": [code("D")], "minimum_assertions_per_candidate": 1,
        "minimum_discriminating_per_candidate": 1, "segment_representation_path": "segments.json", "segment_representation_sha256": sha(seg_text)}))
    source = dict(artifact_id="art", role="clinical_assertions", release="1", access_date="d", source_url="u", local_path="art.txt", sha256=sha("art"),
                  legal_status="approved_for_structured_reuse", redistribution="restricted", evidence_family_id="fam", dependency_type="primary", upstream_reference="up")
    (folder / "sources.json").write_text(json.dumps([source]))
    (folder / "concepts.jsonl").write_text("\n".join(json.dumps(c) for c in [code("D") | {"kind": "condition", "label_en": "Dis"}, code("F") | {"kind": "finding", "label_en": "Fin"}]))
    (folder / "mappings.jsonl").write_text("")
    assertion = dict(assertion_id="a1", subject=code("D"), relation="has_sign", object=code("F"), polarity="present", is_discriminating=True, source_artifact_id="art",
                     source_url="u", source_release="1", access_date="d", evidence_family_id="fam", dependency_type="primary", upstream_reference="up", segment_id="g1",
                     record_locator="p1", source_segment_sha256=sha("words"), review_status="approved", curator={"curator_id": "cur"})
    (folder / "assertions.jsonl").write_text(json.dumps(assertion))
    data = jsonl.read_package(spark, str(folder))
    digest = data["assertions"].select(curation.record_hash(data["assertions"])).first()[0]
    people = [("r1", ["clinical"], True), ("r2", ["mapping"], False)]
    files = [("segments.json", sha(seg_text)), ("art.txt", sha("art"))]
    if reviewed:
        data["reviewers"] = spark.createDataFrame([(p, r, q, f"{p}.txt", "h" + p) for p, r, q in people], jsonl.PACKAGE_SCHEMAS["reviewers"])
        data["reviews"] = spark.createDataFrame([("assertion", "a1", digest, p, "approved") for p, _, _ in people[:pairs]], jsonl.PACKAGE_SCHEMAS["reviews"])
        files += [("r1.txt", "hr1"), ("r2.txt", "hr2")]
    seg, twice = jsonl.read_segments(spark, str(folder / "segments.json"))
    assert twice.count() == 0
    return data, seg, spark.createDataFrame(files, "path string, sha256 string")


def test_curation_gate(spark, tmp_path):
    data, seg, files = package(spark, tmp_path)
    report = curation.audit(data, seg, files)
    assert [tuple(r) for r in report["blockers"].collect()] == []
    assert report["status"].first()["technical_status"] == "publication_ready"
    assert [(r["clinician"], r["mapping_reviewer"]) for r in curation.export_approved(report, data["assertions"]).collect()] == [("r1", "r2")]
    alone = curation.audit(*package(spark, tmp_path, pairs=1))
    assert {r["code"] for r in alone["blockers"].collect()} == {"assertion_review_incomplete", "candidate_publication_threshold"}
    assert alone["status"].first()["technical_status"] == "ready_for_human_review"
    broken = dict(data)
    broken["sources"] = data["sources"].withColumn("redistribution", F.lit("unknown")).withColumn("source_url", F.lit("other"))
    codes = {r["code"] for r in curation.audit(broken, seg, files)["blockers"].collect()}
    assert {"source_redistribution", "assertion_source_url_mismatch"} <= codes
    with pytest.raises(ValueError):
        curation.export_approved(alone, data["assertions"])
    skipped = {r["code"] for r in curation.audit(data, seg, files, verify=False)["blockers"].collect()}
    assert skipped == {"artifact_verification_skipped"}


def test_publishing_moves_the_manifest_only_without_blockers(spark, tmp_path):
    data, seg, files = package(spark, tmp_path)
    folder = str(tmp_path / "published")
    assert curation.published(spark, folder) is None
    refused = curation.publish({**data, "sources": data["sources"].withColumn("redistribution", F.lit("unknown"))}, seg, files, folder)
    assert not refused["blockers"].isEmpty() and curation.published(spark, folder) is None
    assert curation.publish(data, seg, files, folder)["blockers"].isEmpty()
    first = [tuple(r) for r in curation.published(spark, folder).collect()]
    assert len(first) == 1 and curation.manifest(spark, folder).first()["rows"] == 1
    curation.publish({**data, "manifest": data["manifest"].withColumn("status", F.lit("draft"))}, seg, files, folder)
    assert [tuple(r) for r in curation.published(spark, folder).collect()] == first
    curation.publish(data, seg, files, folder)
    assert [r["sequence"] for r in curation.manifest(spark, folder).orderBy("sequence").collect()] == [1, 2]


def test_pending_package_tables(spark, tmp_path):
    data, _, _ = package(spark, tmp_path, reviewed=False)
    tables = build.canonicalize_package(data, assertions_sha256="ff", prefix="pkg")
    assert tables["canonical_assertion"].first()["subject"] == "pkg:D"
    assert tables["evidence_family"].first()["dependency_type"] == "primary"
    merged = build.merge_corpora([tables, tables])
    assert merged["canonical_assertion"].count() == 1
    book = sinks.review_workbook(
        data["assertions"].select(F.col("assertion_id").alias("item_id"), F.lit("assertion").alias("item_type"), F.lit("h").alias("item_sha256"), "source_artifact_id"),
        data["sources"], data["reviews"],
    )
    assert book.first()["reviewed_by"] == ""


def test_documents_hold_a_bounded_number_of_lines(spark, tmp_path):
    from evisift.plans import q_scans

    rows = spark.range(0, 1003, 1, 3).select(F.concat(F.lit(',{"n":'), "id", F.lit("}")).alias("line"))
    for head, first in (('{"a":[{"n":-1}', -1), ('{"a":[', None)):
        folder = tmp_path / f"documents{first}"
        q_scans.documents(head, rows, "]}", str(folder), size=100)
        held = [[e["n"] for e in json.loads(p.read_text())["a"]] for p in folder.glob("part-*")]
        assert len(held) == 12 and all(0 < len(h) <= 101 for h in held)
        assert sorted(n for h in held for n in h if n >= 0) == list(range(1003))
        assert all((h[0] == -1) == (first == -1) for h in held)


def test_association_documents_are_compressed(spark, tmp_path, monkeypatch):
    from evisift.plans import q_scans

    monkeypatch.setattr(q_scans, "fresh_folder", lambda _, name: str(tmp_path / name))
    rows = q_scans.associations(spark, "/root/testdata/sf0.001")
    assert rows.count() == 2 * spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    for language in ("en", "fr"):
        files = list((tmp_path / f"associations-{language}").glob("part-*"))
        assert files and all(f.suffix == ".gz" for f in files)


def test_archive_is_copied_from_files_that_several_tasks_sorted(spark, tmp_path, monkeypatch):
    from evisift.plans import q_scans

    monkeypatch.setattr(q_scans, "fresh_folder", lambda _, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = spark.range(0, 5000).select(F.format_string("%05d é", "id").alias("line"))
        size = lines.agg(F.sum(F.octet_length("line") + 1)).first()[0]
        path = str(tmp_path / "a.tar.gz")
        q_scans.write_archive(lines.orderBy("line"), path, "m.txt", size)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "sorted-lines").glob("part-*"))) > 1
    got = blocks.member_lines(spark, path, member="m.txt").orderBy("ordinal").collect()
    assert [r["value"] for r in got] == [f"{i:05d} é" for i in range(5000)]
