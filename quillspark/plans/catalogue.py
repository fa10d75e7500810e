"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import field_maps as maps
from quillspark.functions import fixed_values as fixed
from quillspark.functions import parsing as P
from quillspark.functions import text as T
from quillspark.operators import curate, graph, index, packed_values, resolve, scoring, search
from quillspark.plans.indexes import built
from quillspark.plans.oracle import SQL
from quillspark.plans.sample import FINDINGS, HEADINGS, PLAN
from quillspark.plans.scratch import materialize
from quillspark.sources import table

def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return resolve.keyed(table(spark, d, "source_record"))


def _index(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the search index over ``documents``, written once."""
    docs = _documents(spark, d)

    def build() -> DataFrame:
        if name == "postings":
            return index.postings(docs, "doc_id", "text", unique=True)
        if name == "tokens":
            return index.token_sets(docs, "doc_id", "text")
        if name == "placed_tokens":
            places = _index(spark, d, "entries").select(F.col("id").alias("doc_id"), "idx")
            return _index(spark, d, "tokens").join(places, "doc_id").select("idx", "tokens")
        if name == "vocabulary":
            return index.vocabulary(_index(spark, d, "postings"))
        if name == "title_postings":
            return index.postings(docs, "doc_id", "title", unique=True)
        if name == "all_vocabulary":
            return _index(spark, d, "vocabulary").select("token").union(_index(spark, d, "title_postings").select("token")).distinct()
        return index.ranked_index(_entries(docs))

    return built(spark, f"{d}/documents.parquet", name, build)


def _entries(docs: DataFrame) -> DataFrame:
    """Documents as search entries: a text's sources are those of all its copies."""
    source = F.lower(F.trim("source"))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("primary"), F.lit("").alias("latin"), source.alias("category"), (F.length("text") >= 1000).alias("has_traditional"), F.col("url").isNotNull().alias("has_evidence"), F.sha2(F.lower(F.trim(F.coalesce("text", F.lit("")))), 256).alias("_h"))
    count = rows.groupBy("_h").agg(F.count_distinct("category").cast("int").alias("n_sources"))
    return rows.join(count, "_h").drop("_h")


def _names(entries: DataFrame) -> DataFrame:
    return entries.select("idx", F.col("primary").alias("names"))


def _searched(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"posted": _index(spark, d, "postings"), "vocab": _index(spark, d, "vocabulary")}


def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d, "postings")


def token_df(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d, "vocabulary")


def search_and(spark: SparkSession, d: str) -> DataFrame:
    return search.all_of(terms=["throb", "temple"], key="doc_id", **_searched(spark, d))


def search_or(spark: SparkSession, d: str) -> DataFrame:
    return search.any_of(terms=["oyster", "vinegar"], key="doc_id", **_searched(spark, d))


def search_minus(spark: SparkSession, d: str) -> DataFrame:
    some = {t: search.any_of(terms=[t], key="doc_id", **_searched(spark, d)) for t in ("oyster", "vinegar")}
    return search.without(some["oyster"], some["vinegar"], "doc_id")


def _search(spark: SparkSession, d: str, query: str, **options) -> DataFrame:
    """Searches names and texts; a document's tokens are those of both."""
    posted = _index(spark, d, "postings").union(_index(spark, d, "title_postings")).withColumnRenamed("doc_id", "id")
    found = search.search(_index(spark, d, "entries"), posted, query, key="id", vocab=_index(spark, d, "all_vocabulary"), **options)
    return found.select("idx", "id", "primary", "n_sources", "score", "total")


def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "On gastro")


def search_category(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "fever", category="harvask-web")


def search_dual(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "fever", dual_only=True)


def search_all(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, " ")


def search_pct(spark: SparkSession, d: str) -> DataFrame:
    top = F.max("score").over(Window.partitionBy())  # of the at most 100 results
    return _search(spark, d, "On gastro").select("idx", "id", F.round(100 * F.col("score") / top).cast("int").alias("pct"))


def index_order(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d, "entries").select("idx", "id", "n_sources")


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "entity").select(T.point_key(F.col("id")).alias("id")).distinct()
    return _records(spark, d).select("rec_id", F.col("id")).union(table(spark, d, "entity").select("row_id", "id")).join(asked, "id", "left_semi").select(F.col("rec_id").alias("row"), "id")


def phrase_in_fields(spark: SparkSession, d: str) -> DataFrame:
    found = index.snippets(table(spark, d, "entry"), "rec_id")
    return search.phrase_in(found, "on waking", "rec_id", ["head", "skin"])


def first_match(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "remedy_ref").where("ref_id % 100 = 0").select(F.col("latin").alias("name"))
    return search.first_match(asked, _names(_index(spark, d, "entries")))


def kept_words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "symptom").select("case_id", "n", "sx_desc").distinct()
    return rows.select("case_id", "n", F.array_join(T.kept_words(F.col("sx_desc"), fixed.STOP_WORDS), " ").alias("kept"))


def word_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "symptom").select("case_id", "n", T.kept_words(F.col("sx_desc"), fixed.STOP_WORDS).alias("w")).distinct()
    return rows.select("case_id", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), T.windows(F.col("w"), k).alias("v")) for k in (2, 3)])).alias("x")).select("case_id", "n", "x.k", F.posexplode("x.v").alias("pos", "words"))


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The query set of the form searches: every hundredth case against all documents."""
    return tuple(table(spark, d, t).where("case_id % 100 = 0") for t in ("symptom", "form_field"))


def _forms(spark: SparkSession, d: str, profile: scoring.Profile) -> DataFrame:
    symptoms, fields = _asked(spark, d)
    found = scoring.ranked_forms(symptoms, fields, _index(spark, d, "tokens"), "doc_id", profile)
    return found.withColumn("matched", F.array_join("matched", "|"))


def form_scores(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d, scoring.SERVER)


def form_scores_browser(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d, scoring.BROWSER)


def form_keywords(spark: SparkSession, d: str) -> DataFrame:
    symptoms, fields = _asked(spark, d)
    return scoring.keywords_used(symptoms, fields, _index(spark, d, "tokens"), "doc_id")


def form_keywords_browser(spark: SparkSession, d: str) -> DataFrame:
    symptoms, fields = _asked(spark, d)
    return scoring.keywords_used(symptoms, fields, _index(spark, d, "tokens"), "doc_id", scoring.BROWSER)


def _planned(spark: SparkSession, d: str) -> dict:
    """Tokens by index position, and names, for search plans."""
    return {"posted": _index(spark, d, "placed_tokens"), "names": _names(_index(spark, d, "entries")), "key": "idx"}


def plan_scores(spark: SparkSession, d: str) -> DataFrame:
    plans = spark.createDataFrame([(1, PLAN)], "case long, plan string")
    return scoring.ranked(scoring.plan_awards(plans, **_planned(spark, d))).withColumn("matched", F.array_join("matched", "|"))


def plan_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Of the asked cases the smallest has a plan, the others go by their forms."""
    symptoms, fields = _asked(spark, d)
    plans = symptoms.agg(F.min("case_id").alias("case")).where("case is not null").withColumn("plan", F.lit(PLAN))
    return scoring.ranked_plans(plans, symptoms, fields, **_planned(spark, d)).withColumn("matched", F.array_join("matched", "|"))


def plan_keywords(spark: SparkSession, d: str) -> DataFrame:
    return scoring.plan_keywords(spark.createDataFrame([(1, PLAN), (2, "no plan")], "case long, plan string"))


def checked_classes(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "form_field").where("field = '_checked' and field_value is not null").select(F.initcap("field_value").alias("item"))
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).select("item", "n", scoring.checked_classes(F.col("item")).alias("c")).select("item", "n", "c.*")


def browser_classes(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "form_field").where("field = '_checked' and field_value is not null").select(F.initcap("field_value").alias("item"))
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).select("item", "n", scoring.first_class(F.col("item")).alias("kind"))


def case_summaries(spark: SparkSession, d: str) -> DataFrame:
    return scoring.case_summaries(table(spark, d, "symptom"), table(spark, d, "form_field"))


def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("rec_id", "key")


def merged_names(spark: SparkSession, d: str) -> DataFrame:
    m = resolve.merged_names(_records(spark, d))
    return m.select("key", "primary", "latin", "category", "n_records", *[F.array_join(c, "|").alias(c) for c in ("common", "synonyms", "sources")])


def merged_block(spark: SparkSession, d: str) -> DataFrame:
    return resolve.merged_block(resolve.block_entries(_records(spark, d)))


def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    e = resolve.block_entries(_records(spark, d).withColumn("key", F.col("rec_id").cast("string")))
    return e.select("key", "field", "kind").distinct().groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))


def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return resolve.corpus_counts(_records(spark, d))


def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    return resolve.summary_counts(records, resolve.merged_names(records))


def summary_entries(spark: SparkSession, d: str) -> DataFrame:
    found = resolve.summary_entries(resolve.merged_names(_records(spark, d)))
    return found.withColumn("synonyms", F.array_join("synonyms", "|")).withColumn("sources", F.array_join("sources", "|"))


def entity_entries(spark: SparkSession, d: str) -> DataFrame:
    found = index.search_entries(table(spark, d, "entity"), "row_id")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("snippets")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    return found.select("row_id", "primary", "latin", "category", "n_sources", "has_traditional", "has_evidence", text.alias("snippets"))


def record_entries(spark: SparkSession, d: str) -> DataFrame:
    """The snippets of source records, whose blocks hold dicts of lists."""
    found = index.search_entries(table(spark, d, "source_record").withColumn("evidence", F.concat(F.lit('{"summary": "seen in "}'))), "rec_id")
    return found.select("rec_id", "n_sources", F.explode("snippets").alias("field", "snippet"))


def deep_merge(spark: SparkSession, d: str) -> DataFrame:
    """The second record of each key merged into the first."""
    rows = resolve.block_entries(_records(spark, d))
    order = rows.select("key", "_at").distinct().withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("_at"))).where("r <= 2")
    pair = materialize(rows.join(order, ["key", "_at"]), "pair")
    return curate.deep_merged(pair.where("r = 1"), pair.where("r = 2"))


def entry_snippets(spark: SparkSession, d: str) -> DataFrame:
    return index.snippets(table(spark, d, "entry"), "rec_id")


def prefix_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entry").select("entry_id", "rec_id", "field", "seq", "text").distinct()
    return curate.first_by_prefix(rows, ["rec_id", "field"], ["seq", "entry_id"]).select("entry_id")


def donor_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entry").select("entry_id", "field", "text", "source_id").distinct()
    return curate.new_texts(rows.where("source_id like '%keynotes%'"), rows.where("source_id like '%synopsis%'"), ["field"]).select("entry_id", "field")


def _nth(values: list[str], key: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def evidence_rating(spark: SparkSession, d: str) -> DataFrame:
    """Each document with one of the findings behind it."""
    return _documents(spark, d).select("doc_id", T.evidence_rating(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _nth(FINDINGS, "doc_id"))).alias("rating"))


def _page() -> Column:
    """A document as a page of a site."""
    t, s, x = (F.coalesce(c, F.lit("")) for c in ("title", "source", "text"))
    lit = F.lit
    head = F.concat(lit("<html><head><title>"), t, lit(" - Herb | Notes</title><script>var p = '<b>';</script><style>p {}</style></head><body><h1>"), t, lit("</h1>"))
    names = F.concat(lit("<p>Common Names: "), t, lit(" tea, old &amp; "), s, lit(" root Latin Names: "), t, lit(" vera, "), s, lit(". Background</p>"))
    return F.concat(head, names, lit("<h2>Background</h2><p>"), x, lit("</p><h2>Uses</h2><p>x</p><p>* * *</p><p>second caf&eacute;</p><h2>Background</h2><p>again</p></body></html>"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", _page().alias("page"))


def page_meta(spark: SparkSession, d: str) -> DataFrame:
    m = _pages(spark, d).select("doc_id", P.meta_lists(F.col("page")).alias("m"))
    return m.select("doc_id", "m.name", F.array_join("m.common", "|").alias("common"), F.array_join("m.latin", "|").alias("latin"))


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("page")
    return _pages(spark, d).select("doc_id", T.markup_title(c).alias("title"), T.markup_title(c, cut=" - ").alias("before"), P.title_after(c).alias("after"), T.title_case(T.markup_title(c, "h1")).alias("cased"))


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    found = T.last_wins(T.headed_sections(F.col("page")))
    return _pages(spark, d).select("doc_id", F.posexplode(found).alias("pos", "s"), P.is_fact_sheet(F.transform(found, lambda s: s["head"])).alias("sheet")).select("doc_id", "pos", "s.head", "s.body", "sheet")


def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", F.posexplode(T.paragraphs(F.col("page"))).alias("pos", "paragraph"))


def herbal_routes(spark: SparkSession, d: str) -> DataFrame:
    """Every entry under one of the headings."""
    rows = table(spark, d, "entry").select("entry_id", "text").distinct().where("text is not null")
    one = F.array(F.struct(_nth(HEADINGS, "entry_id").alias("head"), F.col("text").alias("body")))
    found = rows.select("entry_id", P.herbal_sections(one).alias("h"))
    routed = found.select("entry_id", F.explode("h.sections").alias("s")).select("entry_id", "s.field", "s.text")
    return routed.unionByName(found.where("size(h.synonyms) > 0").select("entry_id", F.lit("synonyms").alias("field"), F.array_join("h.synonyms", "|").alias("text")))


def evidence_routes(spark: SparkSession, d: str) -> DataFrame:
    """Every entry under one of the headings, with the next heading's copy behind it, by the routes of three books."""
    rows = table(spark, d, "entry").select("entry_id", "text").distinct().where("text is not null").withColumn("_n", F.col("entry_id") + 1)
    two = F.array(*[F.struct(_nth(HEADINGS, k).alias("head"), F.col("text").alias("body")) for k in ("entry_id", "_n")])
    books = {
        "lactation": P.routed_sections(two, maps.LACTATION_ROUTES, summary=maps.LACTATION_SUMMARY),
        "liver": P.routed_sections(two, maps.LIVER_ROUTES, summary=maps.LIVER_SUMMARY, only_summary=True),
        "supplement": P.routed_sections(two, maps.SUPPLEMENT_ROUTES, skip=maps.SUPPLEMENT_SKIPPED),
    }
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("book"), v.alias("s")) for k, v in books.items()]))
    return rows.select("entry_id", every.alias("b")).select("entry_id", "b.book", F.posexplode("b.s").alias("pos", "s")).select("entry_id", "book", "pos", "s.field", "s.head", F.length("s.text").alias("length"))


def field_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every entry under a label of each book, known or not."""
    labels = [*maps.NUMBERED, *maps.ANCHORS, "Mind and soul", "stool and blood", "Outer Chest wall", "knees"]
    rows = table(spark, d, "entry").select("entry_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("label", _nth(labels, "entry_id"))
    known = P.labelled_field(F.col("label"), F.col("text"))
    return rows.select("entry_id", "label", P.anchored_field(F.col("label")).alias("anchored"), known["field"].alias("labelled"), known["text"].alias("text"), P.numbered_field(F.col("label")).alias("numbered"), P.chapter_field(F.pmod("entry_id", F.lit(50))).alias("chapter"))


def header_names(spark: SparkSession, d: str) -> DataFrame:
    short = F.coalesce("lang", F.lit("xx"))
    return _documents(spark, d).select("doc_id", P.header_name(F.concat_ws("\n", "title", "text"), short, {"en": "Englishwort", "de": "Germanwort"}).alias("name"))


def botanical_names(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat(F.lit("x Botanical: "), F.coalesce("title", F.lit("")), F.lit(". "), _nth([" Family: y", " --- z", " Description z", ""], "doc_id"))
    return _documents(spark, d).select("doc_id", P.botanical_name(c).alias("name"), P.split_title(F.concat(F.coalesce("title", F.lit("")), _nth([".—Bark.", " - Root", ""], "doc_id"))).alias("t")).select("doc_id", "name", "t.latin", "t.common")


def title_categories(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), _nth([*maps.BOTANICALS, *maps.VITAMINS, "Other", ""], "doc_id"))
    return _documents(spark, d).select("doc_id", P.category(t, maps.BOTANICALS, "herbal", "supplement").alias("by_plant"), P.category(t, maps.VITAMINS, "supplement", "herbal").alias("by_vitamin"))


def denied_pages(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws("", _nth([*maps.NAVIGATION, "illustration-7-", "MyDS-", ""], "doc_id"), F.when(F.pmod("doc_id", F.lit(3)) > 0, T.slug(F.coalesce("title", F.lit("")))))
    return _documents(spark, d).select("doc_id", name.alias("name")).where(~P.denied(F.col("name"), maps.NAVIGATION, maps.NAVIGATION_STARTS, maps.NAVIGATION_PARTS))


def payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", P.valid_payload(F.col("props"), ("k",)).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def modality_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "symptom").select("case_id", "n", F.concat(F.lit("Worse "), F.coalesce("sx_desc", F.lit("")), F.lit(" - better: "), F.coalesce("sx_location", F.lit("")), F.lit("; worse, "), F.coalesce("sx_sensation", F.lit(""))).alias("text")).distinct()
    return rows.select("case_id", "n", F.posexplode(T.modalities(F.col("text"))).alias("pos", "m")).select("case_id", "n", "pos", "m.side", "m.text")


def relation_lists(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat(F.lit("Complementary: "), F.coalesce("title", F.lit("x")), F.lit("; Sulph, . Antidotes to it: "), F.coalesce("source", F.lit("y")), F.lit(" , Camph. Follows well: Bry"))
    return _documents(spark, d).select("doc_id", F.explode(T.relations(c)).alias("kind", "v")).select("doc_id", "kind", F.array_join("v", "|").alias("items"))


def bullet_items(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.posexplode(T.bullets(F.col("text"), r"\n+", 5)).alias("pos", "item"))


def joined_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph-like lines of a document under two alternating headings, strung together by heading."""
    lines = F.split("text", "\n")
    sections = F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("h"), (i % 2).cast("string")).alias("head"), x.alias("body")))
    return _documents(spark, d).where("text is not null").select("doc_id", F.explode(P.joined_sections(sections, "\n", 500)).alias("s")).select("doc_id", "s.head", "s.body")


def slugs(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "source_record").select("rec_id", F.col("names.primary").alias("name")).where("name is not null")
    return names.select("rec_id", *[T.slug(F.col("name"), m).alias(m) for m in T.SLUG_MODES])


def page_links(spark: SparkSession, d: str) -> DataFrame:
    found = _documents(spark, d).select("doc_id", F.posexplode(T.links(F.col("text"))).alias("pos", "url"))
    return found.groupBy("doc_id", "url").agg(F.min("pos").alias("pos"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", T.clean_markup(F.col("page")).alias("plain"), T.clean_escaped(F.col("page")).alias("glued"))


def labelled_sections(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.posexplode(T.labelled_sections(F.col("text"))).alias("pos", "s")).select("doc_id", "pos", "s.label", "s.text")


def numbered_items(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.posexplode(T.numbered_items(F.col("text"))).alias("pos", "item"))


def scanned_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.posexplode(T.scanned_paragraphs(F.col("text"))).alias("pos", "paragraph"))


def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.heading_line(F.col("title")).alias("heading")).where("heading <> ''")


def frequent_marks(spark: SparkSession, d: str) -> DataFrame:
    marks = F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]{2,4}-[a-z]{1,2})\."), F.lit(1))
    return curate.frequent_marks(_documents(spark, d).select(F.posexplode(marks).alias("pos", "mark")), "mark", 3)


def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


def daily_limit(spark: SparkSession, d: str) -> DataFrame:
    return curate.daily_cap(table(spark, d, "events")).select("event_id", "allowed")


def link_bfs(spark: SparkSession, d: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nation = table(spark, d, "nation")
    edges = nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).union(nation.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    edges = edges.union(table(spark, d, "customer").select(name("n", "c_nationkey"), name("c", "c_custkey")))
    return graph.reachable(edges, spark.createDataFrame([("r1",)], "node string"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packed_values.split_relationships(table(spark, d, "source_record"))


_QUERIES = [
    inverted_index,
    token_df,
    search_and,
    search_or,
    search_minus,
    search_ranked,
    search_category,
    search_dual,
    search_all,
    search_pct,
    index_order,
    point_lookup,
    phrase_in_fields,
    first_match,
    kept_words,
    word_windows,
    form_scores,
    form_scores_browser,
    form_keywords,
    form_keywords_browser,
    plan_scores,
    plan_fallback,
    plan_keywords,
    checked_classes,
    case_summaries,
    canonical_keys,
    merged_names,
    merged_block,
    block_kinds,
    corpus_counts,
    entry_snippets,
    prefix_dedup,
    donor_texts,
    evidence_rating,
    slugs,
    page_links,
    page_text,
    labelled_sections,
    numbered_items,
    scanned_paragraphs,
    heading_lines,
    frequent_marks,
    json_props,
    daily_limit,
    link_bfs,
    page_meta,
    page_titles,
    page_sections,
    page_paragraphs,
    herbal_routes,
    evidence_routes,
    field_labels,
    header_names,
    botanical_names,
    title_categories,
    denied_pages,
    payloads,
    modality_chunks,
    relation_lists,
    bullet_items,
    joined_bodies,
    browser_classes,
    summary_counts,
    summary_entries,
    entity_entries,
    record_entries,
    deep_merge,
    p5_found,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
