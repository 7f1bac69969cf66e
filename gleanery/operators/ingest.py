"""From files and pages to documents and chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import clean_text, content_hash, safe_name

PARAGRAPH, SENTENCE = re.compile(r"\n\n+"), re.compile(r"(?<=[.!?])\s+")
CHUNKS = "array<struct<chunk_index:int,text:string,tokens:int,start_char:int,end_char:int>>"


def approx(text: str) -> int:
    return int(len(text.split()) * 1.3)


def pack(units: list[str], joint: str, size: int, overlap: int, count: Callable[[str], int]) -> Iterator[tuple[str, int]]:
    """Runs of units of at most `size` tokens; a run starts with the last units of the one before that fit the overlap."""
    held: list[tuple[str, int]] = []
    for unit in units:
        n = count(unit)
        if held and sum(t for _, t in held) + n > size:
            yield joint.join(u for u, _ in held), sum(t for _, t in held)
            kept, total = [], 0
            for u, t in reversed(held):
                if total + t > overlap:
                    break
                kept.insert(0, (u, t))
                total += t
            held = kept
        held.append((unit, n))
    if held:
        yield joint.join(u for u, _ in held), sum(t for _, t in held)


def chunk(text: str, size: int = 512, overlap: int = 64, least: int = 100, count: Callable[[str], int] = approx) -> list[dict]:
    """Chunks along paragraphs, and along sentences in paragraphs that are too long; chunks under `least` tokens are left out.

    Offsets are where the chunk's first words stand in the text.
    """
    found: list[tuple[str, int]] = []
    run: list[str] = []
    for part in [*filter(None, (p.strip() for p in PARAGRAPH.split(text))), None]:
        if part is not None and count(part) <= size:
            run.append(part)
            continue
        found += pack(run, "\n\n", size, overlap, count)
        run = []
        if part is not None:
            found += pack(SENTENCE.split(part), " ", size, overlap, count)
    out, at = [], 0
    for piece, tokens in found:
        head = re.split(r"\s", piece, maxsplit=1)[0]
        start = max(text.find(piece[:40], at), text.find(head, at), 0) if piece[:40] not in text[at:] else text.find(piece[:40], at)
        at = start
        if count(piece) >= least:
            out.append({"chunk_index": len(out), "text": piece, "tokens": tokens, "start_char": start, "end_char": start + len(piece)})
    return out


def chunks(docs: DataFrame, size: int = 512, overlap: int = 64, least: int = 100) -> DataFrame:
    """(doc_id, chunk_index, text, tokens, start_char, end_char): packing depends on what came before, so it runs over Arrow batches."""

    @F.pandas_udf(CHUNKS)
    def cut_up(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk(t or "", size, overlap, least))

    return docs.select("doc_id", F.explode(cut_up("content")).alias("c")).select("doc_id", "c.*")


def ingest(files: DataFrame, known: DataFrame) -> DataFrame:
    """(filename, content, hash) of files not seen yet, cleaned; of equal texts one stays.

    The hash is of the cleaned text, whatever way a document comes.
    """
    cleaned = files.select("filename", clean_text("content").alias("content")).where("content <> ''").withColumn("hash", content_hash("content"))
    return cleaned.join(known.select("hash"), "hash", "left_anti").dropDuplicates(["hash"]).select("filename", "content", "hash")


# Elements and classes that hold no content, and how others are rendered.
DROPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "iframe", "noscript"}
NOISE = {"mw-editsection", "navbox", "infobox", "sidebar", "mbox", "ambox", "reference", "reflist", "toc", "noprint", "mw-indicators"}
NOISE_IDS = {"mw-navigation", "footer"}
RENDERED = {"h1": "\n# {}\n", "h2": "\n## {}\n", "h3": "\n### {}\n", "h4": "\n#### {}\n", "h5": "\n##### {}\n", "h6": "\n##### {}\n", "li": "- {}", "pre": "\n```\n{}\n```\n", "code": "\n```\n{}\n```\n", "blockquote": "\n> {}\n", "p": "\n{}\n"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Page(HTMLParser):
    """One pass over a page: title, and for each content area its texts and links."""

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[dict] = []
        self.title: list[str] = []
        self.areas: dict[str, dict] = {"": {"open": [], "out": [], "links": []}}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        noise = tag in DROPPED or bool(NOISE & set((a.get("class") or "").split())) or a.get("id") in NOISE_IDS
        node = {"tag": tag, "noise": noise or bool(self.stack and self.stack[-1]["noise"]), "slot": None, "area": None}
        if tag not in VOID:
            self.stack.append(node)
        if node["noise"]:
            return
        for name, here in (("wiki", tag == "div" and a.get("id") == "mw-content-text"), ("main", tag == "main"), ("article", tag == "article"), ("body", tag == "body")):
            if here and name not in self.areas:
                self.areas[name] = {"open": [], "out": [], "links": [], "live": node}
                node["area"] = name
        for area in self.live():
            if tag in RENDERED:
                slot = {"tag": tag, "text": [], "node": node}
                area["out"].append(slot)
                area["open"].append(slot)
            if tag == "a" and a.get("href"):
                area["links"].append(a["href"])

    def live(self) -> list[dict]:
        return [x for x in self.areas.values() if "live" not in x or any(x["live"] is n for n in self.stack)]

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i]["tag"] == tag), None)
        if at is not None:
            gone, self.stack = self.stack[at:], self.stack[:at]
            for area in self.areas.values():
                area["open"] = [s for s in area["open"] if not any(s["node"] is n for n in gone)]

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1]["tag"] == "title":
            self.title.append(data)
        if self.stack and self.stack[-1]["noise"]:
            return
        for area in self.live():
            for slot in area["open"]:
                slot["text"].append(data)


def read_page(html: str | None, base: str | None) -> tuple[str, str, list[str]]:
    """(title, markdown, absolute links) of a page's main content."""
    page = Page()
    page.feed(html or "")
    page.close()
    area = next(page.areas[k] for k in ("wiki", "main", "article", "body", "") if k in page.areas)
    title = re.sub(r"\s*[-–|].*[Ww]iki.*$", "", "".join(page.title).strip() or "Untitled").strip()
    lines = [RENDERED[s["tag"]].format(t) for s in area["out"] if (t := "".join(s["text"]).strip())]
    links = [urljoin(base or "", h) if h.startswith("/") else h for h in area["links"]]
    return title, re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(), [x for x in links if x.startswith("http")]


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, markdown, links) of every page."""

    @F.pandas_udf("title string, markdown string, links array<string>")
    def read(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(h, u) for h, u in zip(html, url, strict=True)], columns=["title", "markdown", "links"])

    return pages.select("page_id", "url", read("html", "url").alias("r")).select("page_id", "url", "r.*")


def crawl(pages: DataFrame, seeds: DataFrame, in_scope: Callable, hops: int = 2, most: int | None = None) -> DataFrame:
    """(url, depth) of pages reached from the seeds over links within scope, breadth first, at most `most` of them.

    pages has url and links. One join a depth; what was visited is left out.
    """
    from gleanery.session import cut

    seen = cut(seeds.select(F.split_part("url", F.lit("#"), F.lit(1)).alias("url")).distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, hops + 1):
        out = pages.join(frontier.select("url"), "url", "left_semi").select(F.explode("links").alias("u")).select(F.split_part("u", F.lit("#"), F.lit(1)).alias("url")).distinct()
        frontier = cut(out.where(in_scope(F.col("url"))).join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    got = seen.join(pages.select("url"), "url", "left_semi")
    return got.orderBy("depth", "url").limit(most) if most else got


def paper_header(title: Column, paper_id: Column, authors: Column, published: Column, categories: Column, url: Column, abstract: Column) -> Column:
    """What goes before the text of a paper."""
    told = [("arXiv ID", paper_id), ("Authors", F.array_join(authors, ", ")), ("Published", F.date_format(published, "yyyy-MM-dd")), ("Categories", F.array_join(categories, ", ")), ("URL", url)]
    return _header(title, told, F.concat(F.lit("## Abstract\n\n"), F.coalesce(abstract, F.lit("")), F.lit("\n\n")))


def page_header(title: Column, url: Column, crawled: Column) -> Column:
    """What goes before the text of a page."""
    return _header(title, [("Source", url), ("Crawled", crawled)], F.lit(""))


def _header(title: Column, told: list[tuple[str, Column]], more: Column) -> Column:
    lines = [F.concat(F.lit(f"**{name}:** "), F.coalesce(c.cast("string"), F.lit(""))) for name, c in told]
    return F.concat(F.lit("# "), F.coalesce(title, F.lit("Untitled")), F.lit("\n\n"), F.concat_ws("\n", *lines), F.lit("\n\n"), more, F.lit("---\n\n"))


def fresh_documents(rows: DataFrame, known: DataFrame, prefix: Column) -> DataFrame:
    """(filename, content, hash, clean) of rows (title, header, text) not seen yet: the hash is of the cleaned text without its header."""
    cleaned = rows.withColumn("clean", clean_text("text")).where("clean <> ''").withColumn("hash", content_hash("clean"))
    new = cleaned.join(known.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
    name = F.concat(prefix, F.lit("_"), safe_name("title"), F.lit(".md"))
    return new.select(name.alias("filename"), F.concat("header", "clean").alias("content"), "hash", "clean")


def ingest_pages(pages: DataFrame, known: DataFrame, source: str, in_scope: Callable | None = None) -> DataFrame:
    """Pages (url, title, markdown, crawled_at) as documents with a header; those out of scope, empty or known are left out."""
    some = pages.where(in_scope(F.col("url"), F.col("markdown"))) if in_scope else pages
    rows = some.select("title", page_header(F.col("title"), F.col("url"), F.col("crawled_at")).alias("header"), F.col("markdown").alias("text"))
    return fresh_documents(rows, known, F.lit(source)).drop("clean")


def ingest_papers(papers: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """Papers whose text (paper_id, text) is at hand as documents with a header; known texts are left out."""
    url = F.concat(F.lit("https://arxiv.org/abs/"), "paper_id")
    header = paper_header(*map(F.col, ("title", "paper_id", "authors", "published", "categories")), url, F.col("summary"))
    rows = papers.join(texts, "paper_id").select("title", header.alias("header"), "text", "paper_id")
    return fresh_documents(rows, known, F.lit("paper")).drop("clean")


def total_tokens(chunked: DataFrame) -> DataFrame:
    """(doc_id, chunks, tokens) of chunks."""
    return chunked.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
