"""Scans of file formats: files in each format are written from the tables into the shared folder and scanned back."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from evisift.operators import resolve
from evisift.plans import build, oracle
from evisift.plans import testbed as tb
from evisift.plans.q_sources import fresh_folder
from evisift.plans.registry import query
from evisift.sources import blocks, jsonl, ontology, tabular, xmlscan

HP = "HP:"


def seven(key):
    return F.lpad(key.cast("string"), 7, "0")


oracle.VIEWS["fx_hp"] = "SELECT *, 'HP:'||lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS code FROM part"


DOCUMENT_ROWS = 50_000


def documents(head, rows, tail, folder, *, size=DOCUMENT_ROWS, **options):
    """Lines ``rows(line)`` as whole documents of at most ``size`` lines between a head and a tail, added to a folder.

    Every task writes its own lines, in documents one after the other, so none holds or reads all of them. A document whose
    head opens a list begins without the comma of its first line.
    """

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(lines):
            return pa.RecordBatch.from_arrays([lines], ["line"])

        def ends(line):
            return out(pa.array([line], pa.string()))

        left = 0
        for batch in batches:
            lines, at = batch.column(0).cast(pa.string()), 0
            while at < len(lines):
                if not left:
                    yield ends(head)
                    left = size
                    if head.endswith("["):
                        yield ends(lines[at].as_py().removeprefix(","))
                        at, left = at + 1, left - 1
                piece = lines.slice(at, left)
                if len(piece):
                    yield out(piece)
                at, left = at + len(piece), left - len(piece)
                if not left:
                    yield ends(tail)
        if left:
            yield ends(tail)

    # files roll over with their documents
    framed_rows = rows.select("line").mapInArrow(framed, "line string")
    framed_rows.write.mode("append").option("maxRecordsPerFile", size + 2).options(**options).text(folder)
    return folder


# --- ontology graphs -----------------------------------------------------------------------


def graph(spark, sf):
    """Parts as a graph document: large ones are deprecated, each is a kind of the next."""

    def build_graph():
        part = tb.table(spark, sf, "part")
        iri = lambda key: F.concat(F.lit("http://purl.obolibrary.org/obo/HP_"), seven(key))
        key = F.col("p_partkey")
        meta = F.struct(
            (F.col("p_size") > 40).alias("deprecated"),
            F.array(F.struct(F.lit("hasExactSynonym").alias("pred"), F.concat_ws(" ", "p_brand", "p_name").alias("val"))).alias("synonyms"),
            F.array(F.struct(F.concat(F.lit("Orphanet:"), key).alias("val")), F.struct(F.concat(F.lit("MESH:D"), key).alias("val"))).alias("xrefs"),
        )
        node = F.to_json(F.struct(iri(key).alias("id"), F.lit("CLASS").alias("type"), F.col("p_name").alias("lbl"), meta.alias("meta")))
        edge = F.to_json(F.struct(iri(key).alias("sub"), F.lit("is_a").alias("pred"), iri(key + 1).alias("obj")))
        # documents of nodes and documents of edges; each graph has both lists
        start, between = '{"graphs":[{"meta":{},"nodes":[{"id":"x:0","type":"PROPERTY"}', '],"edges":[{"sub":"x:0","pred":"none","obj":"x:1"}'
        folder = fresh_folder(spark, "graph")
        documents(start, part.select(F.concat(F.lit(","), node).alias("line")), between + "]}]}", folder)
        return documents(start + between, part.select(F.concat(F.lit(","), edge).alias("line")), "]}]}", folder)

    return ontology.scan(spark, path := build_graph(), prefix=HP, kind="phenotype", release="hp:1"), path


@query("s1_ontology_concepts", "SELECT code, p_name AS label, p_size > 40 AS obsolete FROM fx_hp")
def s1_concepts(spark, sf):
    return graph(spark, sf)[0].concept.select(F.col("external_id").alias("code"), "label", "obsolete")


def named(onto):
    return onto.concept.select("concept_id", F.col("external_id").alias("code"))


@query(
    "s1_ontology_terms",
    "SELECT code, p_name AS text, 'preferred' AS scope FROM fx_hp UNION SELECT code, p_brand||' '||p_name, 'hasExactSynonym' FROM fx_hp",
)
def s1_terms(spark, sf):
    onto, _ = graph(spark, sf)
    return onto.term.join(named(onto), "concept_id").select("code", "text", "scope")


@query(
    "s1_ontology_edges",
    """SELECT a.code AS child, 'HP:'||lpad(CAST(a.p_partkey + 1 AS VARCHAR), 7, '0') AS parent, b.code IS NOT NULL AS resolved
    FROM fx_hp a LEFT JOIN fx_hp b ON b.p_partkey = a.p_partkey + 1""",
)
def s1_edges(spark, sf):
    onto, _ = graph(spark, sf)
    child, parent = (named(onto).toDF(c, f"{c}_code") for c in ("child", "parent"))
    known = onto.edge.join(child, "child").join(parent, "parent").select(F.col("child_code").alias("child"), F.col("parent_code").alias("parent"), F.lit(True).alias("resolved"))
    return known.unionByName(onto.unresolved_edge.toDF("child", "parent").withColumn("resolved", F.lit(False)))


@query("s1_ontology_mappings", "SELECT code, 'ORPHA:'||p_partkey AS target, 'xref' AS relation FROM fx_hp")
def s1_mappings(spark, sf):
    onto, _ = graph(spark, sf)
    return onto.mapping.join(named(onto), "concept_id").select("code", "target", "relation")


@query(
    "s2_xref_identifiers",
    """SELECT code AS concept, 'ORPHA:'||p_partkey AS code, 'https://www.orpha.net' AS system FROM fx_hp
    UNION ALL SELECT code, 'MESH:D'||p_partkey, 'https://id.nlm.nih.gov/mesh/' FROM fx_hp""",
)
def s2_identifiers(spark, sf):
    onto, path = graph(spark, sf)
    found, _ = ontology.scan_xrefs(spark, path, named(onto).withColumnRenamed("code", "primary_code"), "x:1")
    return found.join(named(onto).withColumnRenamed("code", "concept"), "concept_id").select("concept", "code", "system")


@query("s2_xref_mappings", "SELECT code AS source, 'MESH:D'||p_partkey AS target_code, 'unresolved' AS relation, 'unresolved' AS resolution_status FROM fx_hp")
def s2_mappings(spark, sf):
    onto, path = graph(spark, sf)
    _, found = ontology.scan_xrefs(spark, path, named(onto).withColumnRenamed("code", "primary_code"), "x:1")
    return found.join(named(onto).toDF("source_concept_id", "source"), "source_concept_id").select("source", "target_code", "relation", "resolution_status")


# --- XML -----------------------------------------------------------------------------------


def tag(name, body, attributes=""):
    return F.concat(F.lit(f"<{name}{attributes}>"), body, F.lit(f"</{name}>"))


def associations(spark, sf):
    """Order lines as association records in two languages; returned lines are excluded findings."""
    line = tb.table(spark, sf, "lineitem")
    record = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    often = F.when(F.col("l_returnflag") == "A", "28440").when(F.col("l_returnflag") == "N", "28412")
    parts = []
    for language in ("en", "fr"):
        rate = F.coalesce(F.concat(F.lit('<HPOFrequency id="'), often, F.lit(f'"><Name>{language}</Name></HPOFrequency>')), F.lit(""))
        finding = F.concat(F.lit("<HPO><HPOId>HP:"), seven(F.col("l_partkey")), F.lit(f"</HPOId><HPOTerm>{language} term</HPOTerm></HPO>"))
        inner = F.concat(F.lit('<HPODisorderAssociation id="'), record, F.lit('">'), finding, rate, F.lit("</HPODisorderAssociation>"))
        body = F.concat(
            tag("OrphaCode", F.col("l_suppkey").cast("string")), tag("Name", F.concat(F.lit(f"{language} name "), "l_suppkey")),
            F.lit("<ExpertLink>http://x</ExpertLink>"), tag("HPODisorderAssociationList", inner),
        )
        rows = line.select(tag("Disorder", body).alias("line"))
        folder = documents("<JDBOR><DisorderList>", rows, "</DisorderList></JDBOR>", fresh_folder(spark, f"associations-{language}"), compression="gzip")
        parts.append(xmlscan.scan_associations(spark, folder, source="orpha", release="orpha:1", language=language))
    return parts[0].unionByName(parts[1])


oracle.VIEWS["fx_association"] = """
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey) AS record_id, 'ORPHA:'||l_suppkey AS subject_code, l_suppkey, l_partkey,
    'HP:'||lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS finding_code, CASE WHEN l_returnflag = 'A' THEN 'excluded' ELSE 'present' END AS polarity,
    CASE l_returnflag WHEN 'A' THEN '28440' WHEN 'N' THEN '28412' END AS frequency_id FROM lineitem"""


@query(
    "s3_associations",
    """SELECT record_id, language, subject_code, language||' name '||l_suppkey AS subject_label, finding_code, polarity, frequency_id
    FROM fx_association, (VALUES ('en'), ('fr')) AS t(language)""",
)
def s3(spark, sf):
    return associations(spark, sf).select("record_id", "language", "subject_code", "subject_label", "finding_code", "polarity", "frequency_id")


@query(
    "s4_descriptors",
    """SELECT 'D'||p_partkey AS descriptor, concat_ws('|', p_name||' '||p_partkey, lower(p_brand), 'Zeta '||p_partkey) AS terms,
      p_brand||'.'||p_partkey||'|'||p_type||'.'||p_brand AS tree_numbers FROM part""",
)
def s4(spark, sf):
    """Parts as descriptors in gzip archives."""
    part = tb.table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    name = F.concat_ws(" ", "p_name", "p_partkey")
    terms = F.concat(*(tag("Term", tag("String", t)) for t in (F.concat(F.lit("Zeta "), key), name, F.lower("p_brand"))))
    numbers = F.concat(*(tag("TreeNumber", n) for n in (F.concat_ws(".", "p_type", "p_brand"), F.concat_ws(".", "p_brand", "p_partkey"))))
    body = F.concat(
        tag("DescriptorUI", F.concat(F.lit("D"), key)), tag("DescriptorName", tag("String", name)), tag("TreeNumberList", numbers),
        tag("ConceptList", tag("Concept", tag("TermList", terms))),
    )
    rows = part.select(tag("DescriptorRecord", body).alias("line"))
    folder = documents("<DescriptorRecordSet>", rows, "</DescriptorRecordSet>", fresh_folder(spark, "descriptors") + ".xml.gz", compression="gzip")
    got = xmlscan.scan_descriptors(spark, folder)
    return got.select("descriptor", F.array_join("terms", "|").alias("terms"), F.array_join("tree_numbers", "|").alias("tree_numbers"))


def write_archive(lines, path, member, size):
    """One ZIP or tar.gz with a single member of sorted ``lines``.

    All tasks write the sorted lines as compressed files; one task then copies these, in order, into the archive as a stream.
    """
    spark = lines.sparkSession
    staged = fresh_folder(spark, "sorted-lines")
    lines.write.option("compression", "gzip").text(staged)

    def write(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = blocks._opened(path)

        class Body(io.RawIOBase):
            files, source = iter(blocks._files(staged)), None

            def readable(self):
                return True

            def readinto(self, target):
                while True:
                    if self.source is None:
                        name = next(self.files, None)
                        if name is None:
                            return 0
                        where, file = blocks._opened(name)
                        self.source = where.open_input_stream(file, compression="gzip")
                    if data := self.source.read(len(target)):
                        target[: len(data)] = data
                        return len(data)
                    self.source.close()
                    self.source = None

        body = io.BufferedReader(Body(), 1 << 20)
        with system.open_output_stream(inner, compression=None) as out:
            if path.endswith(".zip"):
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(member, "w", force_zip64=True) as entry:
                    while piece := body.read(1 << 20):
                        entry.write(piece)
            else:
                with tarfile.open(fileobj=out, mode="w|gz") as archive:
                    info = tarfile.TarInfo(member)
                    info.size = size
                    archive.addfile(info, body)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["written"])

    spark.range(0, 1, 1, 1).mapInArrow(write, "written long").collect()  # one row


@query(
    "s5_topics",
    """SELECT CAST(c_custkey AS VARCHAR) AS topic_id, c_name AS title, CASE WHEN c_nationkey < 12 THEN 'English' ELSE 'Spanish' END AS language,
      c_mktsegment||' trade|'||lower(c_mktsegment) AS synonyms, '<p>'||c_name||'</p>' AS summary, 'N'||c_nationkey AS heading FROM customer""",
)
def s5(spark, sf):
    """Customers as topics in a ZIP archive."""
    customer = tb.table(spark, sf, "customer")
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    key = F.col("c_custkey").cast("string")
    language = F.when(F.col("c_nationkey") < 12, "English").otherwise("Spanish")
    line = F.concat(
        F.lit("<health-topic"), attribute("id", key), attribute("title", F.col("c_name")), attribute("language", language),
        attribute("url", F.concat(F.lit("http://t/"), key)), F.lit(">"),
        tag("also-called", F.concat("c_mktsegment", F.lit("  trade"))), tag("also-called", F.lower("c_mktsegment")),
        tag("full-summary", F.concat(F.lit("&lt;p&gt;"), "c_name", F.lit("&lt;/p&gt;"))),
        F.lit("<mesh-heading><descriptor"), attribute("id", F.concat(F.lit("N"), "c_nationkey")), F.lit(">nation</descriptor></mesh-heading></health-topic>"),
    )
    rows = customer.select(F.lit(0).alias("place"), F.col("c_custkey").alias("at"), line.alias("line"))
    ends = spark.createDataFrame([(-1, 0, "<health-topics>"), (1, 0, "</health-topics>")], "place int, at long, line string")
    path = fresh_folder(spark, "topics") + ".zip"
    write_archive(ends.unionByName(rows).orderBy("place", "at").select("line"), path, "topics.xml", 0)
    got = xmlscan.scan_topics(spark, path)
    return got.select(
        "topic_id", "title", "language", F.array_join("synonyms", "|").alias("synonyms"), F.get("summaries", F.lit(0)).alias("summary"),
        F.get("headings", F.lit(0))["descriptor_id"].alias("heading"),
    )


# --- graph edges ---------------------------------------------------------------------------

MEMBER = "edges.tsv"


def known_codes(spark, sf):
    supplier, part = tb.table(spark, sf, "supplier"), tb.table(spark, sf, "part")
    subjects = supplier.filter("s_acctbal >= 0").select(F.concat(F.lit("M:"), "s_suppkey").alias("code"))
    findings = part.filter("p_size <= 40").select(F.concat(F.lit(HP), seven(F.col("p_partkey"))).alias("code"))
    return tuple(c.withColumn("concept_id", F.concat(F.lit("c|"), "code")) for c in (subjects, findings))


def graph_edges(spark, sf):
    """Order lines as graph edges in a tar.gz archive, sorted by order and line."""
    line = tb.table(spark, sf, "lineitem")
    columns = {
        "id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "predicate": F.when(F.col("l_linestatus") == "O", tabular.EDGE_PREDICATE).otherwise("biolink:other"),
        "category": F.lit(tabular.EDGE_CATEGORY), "subject": F.concat(F.lit("M:"), "l_suppkey"), "object": F.concat(F.lit(HP), seven(F.col("l_partkey"))),
        "primary_knowledge_source": F.concat(F.lit("infores:"), "l_linenumber"), "aggregator_knowledge_source": F.lit("agg"), "file_source": F.lit("f"),
        "negated": F.when(F.col("l_returnflag") == "A", "True").otherwise(""), "has_count": F.col("l_linenumber").cast("string"), "has_total": F.lit("9"),
    }
    text = line.select(F.concat_ws("\t", *columns.values()).alias("line"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    header = spark.createDataFrame([("\t".join(columns), -1, 0, 0, 0)], text.schema)
    rows = header.unionByName(text)
    size = rows.agg(F.sum(F.octet_length("line") + 1)).first()[0]
    path = fresh_folder(spark, "edges") + ".tar.gz"
    write_archive(rows.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select("line"), path, MEMBER, size)
    subjects, findings = known_codes(spark, sf)
    return tabular.scan_graph_edges(spark, path, member=MEMBER, subjects=subjects, findings=findings)


oracle.VIEWS["fx_graph_edge"] = """
  SELECT * FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS edge_id, 'M:'||l_suppkey AS subject_code,
      'HP:'||lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS finding_code, l_returnflag = 'A' AS negated, CAST(l_linenumber AS INT) AS has_count, l_linestatus,
      l_suppkey, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) + 1 AS row FROM lineitem)
  WHERE l_linestatus = 'O' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)
    AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40)"""


@query(
    "s6_graph_edges",
    "SELECT edge_id, subject_code, finding_code, negated, has_count, 'edges.tsv:row='||row||':id='||edge_id AS source_locator FROM fx_graph_edge",
)
def s6(spark, sf):
    return graph_edges(spark, sf).select("edge_id", "subject_code", "finding_code", "negated", "has_count", "source_locator")


@query(
    "d12_graph_assertions",
    """SELECT 'c|'||subject_code AS subject, 'c|'||finding_code AS finding, CASE WHEN negated THEN 'excluded' ELSE 'present' END AS polarity,
      'infores:'||has_count AS primary_source, CASE WHEN has_count = 1 THEN 'shared_upstream' ELSE 'derived_from' END AS dependency_type,
      has_count = 1 AS common FROM fx_graph_edge""",
)
def d12(spark, sf):
    """Edges as source statements; those of the first source share a family with another release."""
    edges = graph_edges(spark, sf)
    rows = tabular.graph_assertions(
        edges, *known_codes(spark, sf), source="kg", release="1", artifact_sha256="aa", shared={"infores:1": "common-family"}
    )
    return rows.select("subject", "finding", "polarity", "primary_source", "dependency_type", (F.col("family") == "common-family").alias("common"))


# --- curated JSON --------------------------------------------------------------------------


def code_struct(system, code):
    return F.struct(F.lit(system).alias("system"), code.alias("code"))


def curated(spark, sf):
    """Order lines as curated records about suppliers and parts; large parts have no code."""
    line = tb.table(spark, sf, "lineitem")
    rows = line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_id"), F.concat(F.lit("row "), "l_orderkey").alias("record_locator"),
        code_struct("s", F.col("l_suppkey").cast("string")).alias("subject"), F.lit("has_sign").alias("relation"),
        code_struct("p", F.col("l_partkey").cast("string")).alias("object"),
        F.when(F.col("l_returnflag") == "A", "excluded").when(F.col("l_returnflag") == "N", "present").alias("polarity"),
        F.col("l_linestatus").alias("severity"),
    )
    folder = fresh_folder(spark, "curated")
    rows.write.json(folder)
    supplier, part = tb.table(spark, sf, "supplier"), tb.table(spark, sf, "part").filter("p_size <= 40")
    codes = supplier.select(F.lit("s").alias("system"), F.col("s_suppkey").cast("string").alias("code"), F.concat(F.lit("E:"), "s_suppkey").alias("concept_id"))
    codes = codes.unionByName(part.select(F.lit("p").alias("system"), F.col("p_partkey").cast("string").alias("code"), F.concat(F.lit("F:"), "p_partkey").alias("concept_id")))
    return jsonl.scan_curated(spark, folder, codes, source="c", release="1", artifact_sha256="aa")


@query(
    "s8_curated_assertions",
    """SELECT 'E:'||l_suppkey AS subject, 'F:'||l_partkey AS finding, CASE WHEN l_returnflag = 'A' THEN 'excluded' ELSE 'present' END AS polarity,
      l_linestatus AS severity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 40""",
)
def s8(spark, sf):
    return curated(spark, sf)[0].select("subject", "finding", "polarity", "severity")


@query(
    "s8_curated_problems",
    """WITH r AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record_id, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT record_id, 'unknown_code' AS problem FROM r WHERE p_size > 40
    UNION ALL SELECT record_id, 'duplicate_record' FROM r GROUP BY record_id HAVING count(*) > 1""",
)
def s8_problems(spark, sf):
    return curated(spark, sf)[1]


@query(
    "s9_package_assertions",
    """SELECT 'a'||p_partkey AS assertion_id, p_brand AS subject_code, CAST(p_partkey AS VARCHAR) AS object_code, p_size > 40 AS is_discriminating,
      CASE WHEN p_size % 2 = 0 THEN 'approved' ELSE 'pending' END AS review_status, 'https://'||p_type AS source_url, 'draft' AS status FROM part""",
)
def s9(spark, sf):
    """Parts as the assertions of a curation package without reviews, with the source and the package's status."""
    part = tb.table(spark, sf, "part")
    folder = fresh_folder(spark, "package")
    spark.createDataFrame([('{"package_id": "p", "status": "draft"}',)], "value string").coalesce(1).write.text(f"{folder}/manifest.json")
    kinds = part.select(F.col("p_type").alias("artifact_id"), F.concat(F.lit("https://"), "p_type").alias("source_url")).distinct()
    # a handful of sources as one JSON list
    kinds.agg(F.to_json(F.collect_list(F.struct("artifact_id", "source_url"))).alias("value")).coalesce(1).write.text(f"{folder}/sources.json")
    part.select(
        F.concat(F.lit("a"), "p_partkey").alias("assertion_id"), code_struct("b", F.col("p_brand")).alias("subject"),
        code_struct("p", F.col("p_partkey").cast("string")).alias("object"), (F.col("p_size") > 40).alias("is_discriminating"),
        F.col("p_type").alias("source_artifact_id"), F.when(F.col("p_size") % 2 == 0, "approved").otherwise("pending").alias("review_status"),
    ).write.json(f"{folder}/assertions.jsonl")
    part.select(F.lit("p").alias("system"), F.col("p_partkey").cast("string").alias("code")).write.json(f"{folder}/concepts.jsonl")
    part.select(F.concat(F.lit("m"), "p_partkey").alias("mapping_id")).write.json(f"{folder}/mappings.jsonl")
    got = jsonl.read_package(spark, folder)
    sources = got["sources"].select(F.col("artifact_id").alias("source_artifact_id"), F.col("source_url").alias("url"))
    status = got["manifest"].select("status")
    return got["assertions"].join(sources, "source_artifact_id").select(
        "assertion_id", F.col("subject.code").alias("subject_code"), F.col("object.code").alias("object_code"), "is_discriminating", "review_status",
        F.col("url").alias("source_url"), status.scalar().alias("status"),
    )


@query(
    "s10_segments",
    "SELECT CAST(doc_id AS VARCHAR) AS segment_id, source AS artifact_id, 'line '||n_chars AS locator, text FROM documents WHERE text IS NOT NULL",
)
def s10(spark, sf):
    """Documents as the segments of JSON documents, read back in byte ranges."""
    docs = tb.table(spark, sf, "documents").filter("text IS NOT NULL")
    segment = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("segment_id"), F.col("source").alias("artifact_id"), F.concat(F.lit("line "), "n_chars").alias("locator"), "text"
    ))
    rows = docs.select(F.concat(F.lit(","), segment).alias("line"))
    # the first segment of a document has no id: it is listed as a problem and left out of the comparison
    folder = documents('{"segments":[{"text":"first"}', rows, "]}", fresh_folder(spark, "segments"))
    return jsonl.read_segments(spark, folder)[0].filter("segment_id IS NOT NULL").select("segment_id", "artifact_id", "locator", "text")


@query(
    "s13_lexicon",
    """SELECT 'P:'||p_partkey AS code, language, CASE scope WHEN 'ui_alias' THEN p_brand ELSE language||' '||p_name END AS text, scope,
      CASE scope WHEN 'ui_preferred' THEN p_name||'?' END AS question
    FROM part, (VALUES ('fr'), ('de'), ('en')) AS l(language), (VALUES ('ui_alias'), ('ui_preferred')) AS s(scope)""",
)
def s13(spark, sf):
    """Parts as entries of a display lexicon."""
    part = tb.table(spark, sf, "part")
    per = lambda value: F.struct(*(value(lang).alias(lang) for lang in jsonl.LANGUAGES))
    entry = F.to_json(F.struct(
        F.concat(F.lit("P:"), "p_partkey").alias("code"), per(lambda lang: F.concat(F.lit(f"{lang} "), "p_name")).alias("labels"),
        per(lambda lang: F.array("p_brand")).alias("aliases"), per(lambda lang: F.concat("p_name", F.lit("?"))).alias("questions"),
    ))
    rows = part.select(F.concat(F.lit(","), entry).alias("line"))
    folder = documents('{"version":"1","entries":[', rows, "]}", fresh_folder(spark, "lexicon"))
    return jsonl.read_lexicon(spark, folder)


# --- projection of the simple tables -------------------------------------------------------


def projected(spark, sf):
    onto, _ = graph(spark, sf)
    both = associations(spark, sf)
    merged, _ = resolve.merge_bilingual(
        both.select("record_id", "language", "subject_code", "finding_code", "polarity", "frequency", F.concat_ws(":", "language", "subject_label").alias("provenance"))
    )
    findings = onto.concept.select(F.col("external_id").alias("finding_code"), F.col("concept_id").alias("finding"))
    assertion = merged.join(findings, "finding_code").select(
        F.col("subject_code").alias("subject"), "finding", F.lit("orpha").alias("source"), F.lit("1").alias("release_name"),
        F.array(F.lit("aa"), F.lit("bb")).alias("artifact_hashes"), "record_id", "polarity", "frequency",
    )
    tables = {"concept": onto.concept, "term": onto.term, "identifier": onto.identifier, "edge": onto.edge, "mapping": onto.mapping, "assertion": assertion}
    return build.project_simple_tables(tables)


@query("d5_projected_concepts", "SELECT code AS primary_code, 'finding' AS kind, CASE WHEN p_size > 40 THEN 'obsolete' ELSE 'active' END AS status, 'hp:1' AS release FROM fx_hp")
def d5_concepts(spark, sf):
    return projected(spark, sf)["concept"].select("primary_code", "kind", "status", "release")


@query(
    "d5_projected_statements",
    """SELECT subject_code AS subject, polarity, count(*) AS statements FROM (
      SELECT DISTINCT subject_code, finding_code, polarity, frequency_id FROM fx_association) GROUP BY 1, 2""",
)
def d5_statements(spark, sf):
    """Distinct statements of the bilingual records, per subject and polarity."""
    return projected(spark, sf)["canonical_assertion"].groupBy("subject", "polarity").agg(F.count("*").alias("statements"))
