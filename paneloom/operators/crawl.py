"""Parsing of list payloads and detail pages; one Arrow pass for HTML, SQL for JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.text import collapse, join_nonblank, stable_id_sha1
from paneloom.session import ship_package

# List payload as declared by its source.
PAYLOAD = "struct<result: struct<data: struct<list: array<struct<pub_url: string, maintitle: string, fwzh: string, cwrq: string, publish_time: string>>, pager: struct<pageNo: int, pageCount: int, total: int, pageSize: int>>>>"

# Where the text of a page stands, words of official titles, agencies by how a title or a document
# number begins, the site's suffix, labels, and the forms of dates and of links to files.
SELECTORS = (".pages_content", ".article", ".content", ".TRS_Editor", "#UCAP-CONTENT", "article")
DOCUMENT_WORDS = ["通知", "意见", "办法", "规划", "方案", "公告", "通告"]
AGENCIES = [("国务院办公厅", "国务院办公厅"), ("国务院", "国务院")]
NUMBER_AGENCIES = [("国令", "国务院")]
SITE_SUFFIX = "_中国政府网"
SUBJECT_LABEL = "主题分类"
SUBJECT_CLASS = ".zcwj_ztfl"
AGENCY_METAS = ("source", "ContentSource")
ATTACHMENT_WORD = "附件"
DATE_SIGNS = {ord("年"): "-", ord("月"): "-", ord("日"): None}
DATE = re.compile(r"(?:发布时间|发布日期|成文日期)[:：\s]*([0-9]{4}[-年][0-9]{1,2}[-月][0-9]{1,2})")
ATTACHMENT = re.compile(r"\.(pdf|doc|docx|xls|xlsx|wps|zip)(?:$|[?#])", re.I)

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style"}


class Region:
    """An element whose text is wanted: what it is, where it stands among its siblings, and the pieces of its text."""

    __slots__ = ("name", "classes", "id", "attrs", "parent", "pieces")

    def __init__(self, name: str, attrs: dict[str, str], parent: int):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.classes, self.id, self.pieces = attrs.get("class", "").split(), attrs.get("id"), []

    def fits(self, selector: str) -> bool:
        """A name, ``.class`` or ``#id``."""
        kind, rest = selector[0], selector[1:]
        return rest in self.classes if kind == "." else rest == self.id if kind == "#" else self.name == selector

    def text(self) -> str:
        return " ".join(" ".join(self.pieces).split())


class PageReader(HTMLParser):
    """Reads a page once, as a stream of tags, and keeps the regions that any of the wanted selectors fits, in order.

    No tree is built: a stack holds the open elements, and text goes to those of them that are wanted. The first
    region is the page itself.
    """

    def __init__(self, wanted: Sequence[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted = tuple(wanted)
        self.regions = [Region("", {}, -1)]
        self._open: list[tuple[str, int, Region | None]] = []  # (name, number, region if wanted)
        self._seen = 0

    def _begin(self, tag: str, attrs: list[tuple[str, str | None]]) -> Region | None:
        self._seen += 1
        found = Region(tag, {k: v or "" for k, v in attrs}, self._open[-1][1] if self._open else 0)
        if not any(map(found.fits, self.wanted)):
            return None
        self.regions.append(found)
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        region = self._begin(tag, attrs)
        if tag not in _VOID:
            self._open.append((tag, self._seen, region))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._begin(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        depth = max((i for i, (name, _, _) in enumerate(self._open) if name == tag), default=None)
        if depth is not None:
            del self._open[depth:]

    def handle_data(self, data: str) -> None:
        if data.strip() and not any(name in _SILENT for name, _, _ in self._open):
            for region in (self.regions[0], *(r for _, _, r in self._open if r is not None)):
                region.pieces.append(data)

    def of(self, selector: str) -> list[Region]:
        return [r for r in self.regions[1:] if r.fits(selector)]


def read_page(html: str | None, wanted: Sequence[str] = (), references: Sequence[str] | None = None) -> PageReader:
    """references are the character references to decode, such as lt or #39, where a semicolon ends them; all others stay
    as they are written. None decodes all that HTML knows, as browsers do, some of them also without a semicolon.
    """
    text = html or ""
    if references is not None:  # every other ampersand stands for itself
        text = re.sub(f"&(?!(?:{'|'.join(map(re.escape, references))});)", "&amp;", text)
    reader = PageReader(wanted)
    reader.feed(text)
    reader.close()
    return reader


def strip_tags(html: str | None) -> str:
    """The text of a page, pieces between tags apart."""
    return read_page(html).regions[0].text()


def plain_title(markup: str | None) -> str:
    """The text of a marked-up title: entities decoded, pieces between tags put together without a gap."""
    return " ".join("".join(p.strip() for p in read_page(markup).regions[0].pieces).split())


def title_of(text: str) -> str:
    """Without the site's suffix, and only what stands before an underscore."""
    return " ".join(text.replace(SITE_SUFFIX, "").split()).split("_")[0]


def _categories(page: PageReader) -> list[str]:
    """Subject categories, separated by backslashes: the region of that class, else the cell after one that holds the label."""
    cells = page.of("td")
    after = ((one, [c for c in cells[i + 1 :] if c.parent == one.parent]) for i, one in enumerate(cells))
    labelled = (rest[0] for one, rest in after if rest and SUBJECT_LABEL in one.text())
    region = next(iter(page.of(SUBJECT_CLASS)), None) or next(labelled, None)
    return [part for part in map(str.strip, region.text().split("\\")) if part] if region else []


def _body(page: PageReader, selectors: Sequence[str], least: int) -> str:
    """Text of the first selector's region that is long enough; else the last one's that is there; else the whole page's."""
    texts = [found[0].text() for found in map(page.of, selectors) if found]
    return next((t for t in texts if len(t) >= least), texts[-1] if texts else "") or page.regions[0].text()


def _files(page: PageReader, url: str | None) -> list[str]:
    return [urljoin(url or "", a.attrs["href"]) for a in page.of("a") if "href" in a.attrs and (ATTACHMENT.search(a.attrs["href"]) or ATTACHMENT_WORD in a.text())]


# What is read of a detail page; each entry is a function of (page, url, selectors, least length of a body).
FIELDS: dict[str, Callable] = {
    "title": lambda page, *_: next((t for s in ("h1", "title") for t in [title_of(r.text()) for r in page.of(s)[:1]] if t), ""),
    "agency": lambda page, *_: next((" ".join(r.attrs["content"].split()) for k in AGENCY_METAS for r in page.of("meta") if r.attrs.get("name") == k and r.attrs.get("content")), ""),
    "body": lambda page, url, selectors, least: _body(page, selectors, least),
    "publish_date": lambda page, url, selectors, least: next((m[1].translate(DATE_SIGNS) for m in DATE.finditer(_body(page, selectors, least))), None),
    "subject_categories": lambda page, *_: _categories(page),
    "attachment_urls": lambda page, url, *_: _files(page, url),
}


def parse_page(html: str | None, url: str | None, selectors: Sequence[str], least: int = 80, references: Sequence[str] | None = None) -> dict:
    """FIELDS of one detail page, from one pass over it."""
    page = read_page(html, [*selectors, "h1", "title", "meta", "td", "a", SUBJECT_CLASS], references)
    return {name: read(page, url, selectors, least) for name, read in FIELDS.items()}


PAGE = "struct<title: string, agency: string, body: string, publish_date: string, subject_categories: array<string>, attachment_urls: array<string>>"


def parse_details(
    pages: DataFrame, key: str, url: str, html: str, selectors: tuple[str, ...] = SELECTORS, short: int = 80, review: int = 200,
    title: str | None = None, number: str | None = None, listed_day: str | None = None, candidate: str | None = None, error: str | None = None,
    references: Sequence[str] | None = None,
) -> DataFrame:
    """One record for each page: parsed fields, ids, document type, parse and review status.

    title, number, listed_day and candidate (its id) name columns of the list the page was found on; they fill what the
    page lacks. error names a column that says why a page could not be fetched: such a page is a record, too, with
    status detail_failed, the fields of the list, and nothing of its own. references are those that read_page decodes.
    """
    ship_package(pages.sparkSession)

    @F.pandas_udf(PAGE)
    def parse(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(x, y, selectors, references=references) for x, y in zip(h, u, strict=True)], columns=list(FIELDS))

    hint = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    why = F.nullif(hint(error), F.lit(""))
    out = pages.select(
        key, F.col(url).alias("source_url"), hint(title).alias("_title"), hint(number).alias("_number"), hint(listed_day).alias("_day"),
        F.nullif(hint(candidate), F.lit("")).alias("_id"), why.alias("error"), parse(F.when(why.isNull(), F.col(html)), F.col(url)).alias("p"),
    ).select(key, "source_url", "_title", "_number", "_day", "_id", "error", "p.*")
    failed = F.col("error").isNotNull()
    out = out.withColumn("title", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("_title"))).withColumn("publish_date", F.coalesce("publish_date", F.nullif(F.substring_index("_day", " ", 1), F.lit(""))))
    by_title = lambda c: [F.when(F.startswith(c, F.lit(a)), F.lit(b)) for a, b in AGENCIES]
    by_number = [F.when(F.startswith("_number", F.lit(a)), F.lit(b)) for a, b in NUMBER_AGENCIES]
    named = F.coalesce(*by_title("title"), *by_number, F.nullif(F.col("agency"), F.lit("")), *by_title("_title"))
    kind = F.when(F.rlike("title", F.lit("|".join(DOCUMENT_WORDS))), "policy_document").when(F.size("attachment_urls") > 0, "attachment_page").otherwise("needs_review")
    return out.withColumns({
        "agency": F.when(~failed, named), "document_type": F.when(~failed, kind), "policy_id": F.coalesce("_id", stable_id_sha1("source_url", "page_")), "text_length": F.length("body").cast("bigint"),
        "parse_status": F.when(failed, "detail_failed").when(F.length("body") >= short, "success").otherwise("partial"), "review_status": F.when(failed | (F.length("body") < review), "needs_review").otherwise("accepted"),
        "text_hash": F.when(F.col("body") != "", F.sha2(F.col("body").cast("binary"), 256)),
    }).drop("_title", "_number", "_day", "_id")


def fetch_pages(candidates: DataFrame, url: str, client: Callable[[], Callable[[str], tuple[str, str]]]) -> DataFrame:
    """candidates, each URL once, with html, final_url and error; a page that can't be fetched is a row with its error.

    client is called once for each task and returns a function from a URL to (html, URL after redirects).
    """
    ship_package(candidates.sparkSession)
    once = candidates.dropDuplicates([url])
    at = once.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = client()
        for b in batches:
            rows = []
            for u in b.column(at).to_pylist():
                try:
                    rows.append((*get(u), None))
                except Exception as e:  # a failed fetch is a row of the result
                    rows.append((None, u, repr(e)))
            html, final, error = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.string()) for x in (html, final, error))], [*b.schema.names, "html", "final_url", "error"])

    fields = [*once.schema.fields, *(T.StructField(c, T.StringType()) for c in ("html", "final_url", "error"))]
    return once.mapInArrow(run, T.StructType(fields))


# --- lists


def resolve_url(link: Column, base: str) -> Column:
    """A reference against a base URL, by RFC 3986: other schemes as they are, hosts, absolute and relative paths with dots, queries and fragments."""
    at = urlsplit(base)
    site = f"{at.scheme}://{at.netloc}"
    folder = [x for x in at.path.split("/")[:-1] if x]
    path, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)

    def walked(parts: Column) -> Column:
        """The path of the parts: a single dot stays, two dots go up, at most to the root; a dot at the end leaves a slash."""
        up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        step = lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        dotted = F.element_at(parts, -1).isin(".", "..")
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(dotted & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))

    own = F.split(path, "/")
    relative = F.concat(F.array(*map(F.lit, folder)).cast("array<string>"), F.filter(F.slice(own, F.lit(1), F.size(own) - 1), lambda x: x != ""), F.slice(own, -1, 1))
    whole = base.split("#")[0]
    return (
        F.when(link == "", F.lit(base))
        .when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit(f"{at.scheme}:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(F.lit(site), walked(F.slice(own, F.lit(2), F.size(own))), rest))
        .when(F.startswith(link, F.lit("?")), F.concat(F.lit(whole.split("?")[0]), link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.lit(whole), link))
        .otherwise(F.concat(F.lit(site), walked(relative), rest))
    )


def parse_list_payloads(df: DataFrame, payload: str, base_url: str, prefix: str = "candidate_") -> DataFrame:
    """Candidates of list payloads: one row for each listed item, with the pager's fields. Bad JSON gives no item. base_url is the page whose links they are."""
    ship_package(df.sparkSession)
    parsed = df.withColumn("_p", F.from_json(F.col(payload), PAYLOAD))
    items = parsed.withColumn("_i", F.explode(F.coalesce("_p.result.data.list", F.array().cast("array<struct<pub_url: string, maintitle: string, fwzh: string, cwrq: string, publish_time: string>>"))))
    url = resolve_url(F.coalesce("_i.pub_url", F.lit("")), base_url.rstrip("/") + "/")
    pager = lambda c: F.col(f"_p.result.data.pager.{c}")

    @F.arrow_udf("string")
    def plain(markup: pa.Array) -> pa.Array:
        return pa.array([None if t is None else plain_title(t) for t in markup.to_pylist()], pa.string())

    raw = F.coalesce("_i.maintitle", F.lit(""))
    marked = F.rlike(raw, F.lit("[<&]"))
    title = F.when(marked, plain(F.when(marked, raw))).otherwise(collapse(raw))
    return items.select(
        *df.columns, url.alias("source_url"), stable_id_sha1(url, prefix).alias("candidate_id"), title.alias("title"),
        collapse("_i.fwzh").alias("fwzh"), F.col("_i.cwrq").alias("cwrq"), F.col("_i.publish_time").alias("publish_time"),
        F.coalesce(pager("pageNo"), F.lit(1)).alias("page_no"), pager("total").alias("list_total"), pager("pageCount").alias("list_page_count"), pager("pageSize").alias("list_page_size"),
    )


def list_pages(df: DataFrame, payload: str) -> DataFrame:
    """What paging needs of each list payload, also of one that lists nothing: listed, oldest day, page_no, page_count."""
    parsed = df.withColumn("_d", F.from_json(F.col(payload), PAYLOAD)["result"]["data"])
    items, no = F.coalesce("_d.list", F.array().cast("array<struct<pub_url: string, maintitle: string, fwzh: string, cwrq: string, publish_time: string>>")), F.nullif(F.col("_d.pager.pageNo"), F.lit(0))
    day = lambda i: F.coalesce(F.nullif(i["publish_time"], F.lit("")), F.nullif(i["cwrq"], F.lit(""))).try_cast("timestamp").cast("date")
    out = parsed.withColumns({"listed": F.size(items), "oldest": F.array_min(F.transform(items, day)), "page_no": F.coalesce(no, F.lit(1))})
    return out.withColumn("page_count", F.coalesce(F.nullif(F.col("_d.pager.pageCount"), F.lit(0)), F.col("page_no"))).drop("_d")


def payload_status(df: DataFrame, body: str) -> DataFrame:
    """ok, empty or bad_json for each raw artifact: a broken file is a row, not an exception. What follows a whole value, too, makes a file broken."""
    ship_package(df.sparkSession)

    @F.arrow_udf("boolean")
    def whole(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else is_json(t) for t in text.to_pylist()], pa.bool_())

    blank = F.coalesce(F.trim(body), F.lit("")) == ""
    return df.withColumn("artifact_status", F.when(blank, "empty").when(whole(F.col(body)), "ok").otherwise("bad_json"))


def is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


# The fields of a list request, and those that it asks for.
RESULT_FIELDS = ["pub_url", "maintitle", "fwzh", "cwrq", "publish_time"]


def request_body(code: str, third_party: str, table: int, field: Column, word: Column, precise: Column, sort: Column, size: Column, page: Column) -> Column:
    """The JSON body of one list request (signing and sending are outside this library)."""
    search = F.struct(F.coalesce(field, F.lit("")).alias("fieldName"), F.coalesce(word, F.lit("")).alias("searchWord"))
    order = F.struct(F.coalesce(sort, F.lit("")).alias("sortField"), F.lit("DESC").alias("sortOrder"))
    return F.to_json(F.struct(
        F.lit(code).alias("code"), F.lit(third_party).alias("thirdPartyCode"), F.lit(table).alias("thirdPartyTableId"), F.array(*map(F.lit, RESULT_FIELDS)).alias("resultFields"), F.lit("true").alias("trackTotalHits"),
        F.array(search).alias("searchFields"), precise.alias("isPreciseSearch"), F.array(order).alias("sorts"), F.array().cast("array<string>").alias("childrenInfoIds"), size.alias("pageSize"), page.alias("pageNo"),
    ))


def text_surface(*columns: str, separator: str) -> Column:
    """Columns joined by a separator, nulls as empty, so that each keeps its place."""
    return F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def reason_text(*reasons: Column) -> Column:
    return join_nonblank(";", *reasons)
