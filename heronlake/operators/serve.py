"""Search requests to feeds: parsing, query choice, items, markup and JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions import text
from heronlake.operators import catalog, dml
from heronlake.schemas import CONTENT_TYPES, STATES

NAMESPACE = "http://torznab.com/schemas/2015/feed"
LINK_TYPE = "application/x-bittorrent;x-scheme-handler/magnet"
HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n'
#: Item columns that become attributes, in order, where they are not empty.
OPTIONAL = (("imdbid", "imdb_id"), ("resolution", "quality"), ("encoding", "encoding"), ("dynamicrange", "dynamic_range"), ("source", "source"), ("releasegroup", "release_group"), ("series", "series_name"), ("season", "season"), ("episode", "episode"), ("title", "movie_title"), ("year", "year"))


@dataclass(frozen=True)
class Request:
    function: str = ""
    q: str | None = None
    imdb_id: str | None = None
    season: int | None = None
    episode: int | None = None
    categories: tuple[int, ...] = ()
    limit: int = 0
    offset: int = 0


def _int(s: str | None) -> int:
    try:
        return int(s or "")
    except ValueError:
        return 0


def parse(args: dict[str, str]) -> Request:
    """Numbers that are none are 0; categories that are none are skipped; an empty q, season or ep is no filter."""
    cats = tuple(int(c) for c in (args.get("cat") or "").split(",") if c.strip().lstrip("-").isdigit())
    return Request(args.get("t", ""), args.get("q") or None, args.get("imdbid") or None, _int(args.get("season")) or None, _int(args.get("ep")) or None, cats, _int(args.get("limit")), max(0, _int(args.get("offset"))))


def search(request: Request, tables: dict[str, DataFrame], filter_categories: bool = False) -> DataFrame:
    """The rows a request asks for; an imdb id wins over words and is not paged. Categories filter only if asked to."""
    t, r = tables["torrents"], request
    if r.function == "movie":
        rows = catalog.movies_by_imdb(t, tables["tmdb_movies"], r.imdb_id) if r.imdb_id else catalog.search_movies(t, tables["tmdb_movies"], r.q, r.limit, r.offset)
        rows = rows.withColumnRenamed("title", "movie_title")
    elif r.function == "tvsearch":
        rows = catalog.tv_by_imdb(t, tables["tmdb_tv"], r.imdb_id, r.season, r.episode) if r.imdb_id else catalog.search_tv(t, tables["tmdb_tv"], r.q, r.season, r.episode, r.limit, r.offset)
    else:
        rows = catalog.search_all(t, r.q, r.limit, r.offset)
    if filter_categories and r.categories:
        rows = rows.where(F.arrays_overlap(text.categories(F.col("content_type"), F.col("quality")), F.array(*map(F.lit, r.categories))))
    return rows


def _element(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), text.escape(body), F.lit(f"</{name}>"))


def _attr(name: Column, value: Column) -> Column:
    return F.concat(F.lit('<torznab:attr name="'), name, F.lit('" value="'), text.escape(value), F.lit('"></torznab:attr>'))


def item(columns: list[str]) -> Column:
    """One feed item of a catalogue row; missing columns are empty."""
    col = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in columns else F.lit("")
    link = text.magnet(F.col("infohash"), F.col("name"))
    cats = text.categories(F.col("content_type"), F.col("quality") if "quality" in columns else F.lit(""))
    attrs = [_attr(F.lit(a), col(a)) for a in ("seeders", "leechers", "infohash")]
    attrs.append(F.array_join(F.transform(cats, lambda c: _attr(F.lit("category"), c.cast("string"))), ""))
    for a, c in OPTIONAL:
        if c in columns:
            attrs.append(F.when((col(c) == "") | (col(c) == "0"), "").otherwise(_attr(F.lit(a), col(c))))
    published = text.mail_date(F.col("first_seen")) if "first_seen" in columns else F.lit("")
    return F.concat(
        F.lit("<item>"), _element("title", F.col("name")), F.lit('<guid isPermaLink="false">'), F.col("infohash"), F.lit("</guid>"), _element("link", link),
        F.lit('<enclosure url="'), text.escape(link), F.lit('" length="'), F.col("total_size").cast("string"), F.lit(f'" type="{LINK_TYPE}"></enclosure>'), _element("size", F.col("total_size").cast("string")),
        F.lit("<pubDate>"), published, F.lit("</pubDate>"), *attrs, F.lit("</item>"),
    )


def items(rows: DataFrame) -> DataFrame:
    return rows.select("infohash", item(rows.columns).alias("item"))


def indented(document: str) -> str:
    """Markup with a line an element and two spaces a level; elements with text alone stay on one line."""
    out, depth = [], 0
    for part in re.finditer(r"<\?[^>]*\?>|<([\w:-]+)[^>]*>[^<]*</\1>|<[^>]*>", document):
        tag = part[0]
        depth -= tag.startswith("</")
        out.append("  " * depth + tag)
        depth += not (tag.startswith(("</", "<?")) or part[1])
    return "\n".join(out)


def feed(rows: DataFrame, title: str = "catalogue", description: str = "Release catalogue") -> str:
    """The RSS document of a page, whose length the request bounds."""
    body = "".join(r["item"] for r in rows.select(item(rows.columns).alias("item")).toLocalIterator())
    return indented(f'{HEADER}<rss version="2.0" xmlns:torznab="{NAMESPACE}"><channel><title>{title}</title><description>{description}</description>{body}</channel></rss>')


def caps(title: str = "catalogue") -> str:
    """What can be asked for: limits, searches, categories."""
    modes = {"search": "q", "movie-search": "q,imdbid", "tv-search": "q,season,ep,imdbid", "audio-search": "", "book-search": ""}
    searching = "".join(f'<{m} available="{"yes" if p else "no"}" supportedParams="{p}"></{m}>' for m, p in modes.items())
    cats = "".join(f'<category id="{top}" name="{name}">' + "".join(f'<subcat id="{i}" name="{n}"></subcat>' for n, i in sub.items()) + "</category>" for name, (top, sub) in text.CATEGORIES.items())
    return f'{HEADER}<caps><server title="{title}"></server><limits max="100" default="50"></limits><searching>{searching}</searching><categories>{cats}</categories></caps>'


def error(code: int, description: str) -> str:
    clean = description.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&#34;").replace("'", "&#39;")
    return f'{HEADER}<error code="{code}" description="{clean}"></error>'


def handle(args: dict[str, str], tables: dict[str, DataFrame]) -> str:
    """The document that answers a request: unknown functions are error 202, failures 300."""
    r = parse(args)
    if r.function == "caps":
        return caps()
    if r.function not in ("search", "movie", "tvsearch"):
        return error(202, "No such function")
    try:
        return feed(search(r, tables))
    except Exception as e:
        return error(300, str(e).splitlines()[0])


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


class Api:
    """List, get, patch and delete over tables; answers are (status, body).

    With a ``store`` (:class:`heronlake.sources.tables.TableStore`) changes are new versions there, and later reads see them.
    """

    def __init__(self, tables: dict[str, DataFrame], store=None):
        self.tables, self.store = tables, store

    def _keep(self, changed: dict[str, DataFrame]) -> None:
        if self.store:
            self.store.commit(changed)
            changed = {t: self.store.read(t) for t in changed}
        self.tables |= changed

    def pages(self, limit: int = 50, **filters) -> Iterator[list[str]]:
        """Page after page of :meth:`list`; the last is short."""
        offset = 0
        while True:
            status, rows = self.list(limit=limit, offset=offset, **filters)
            if status != 200:
                raise ValueError(rows)
            if rows:
                yield rows
            if len(rows) < limit:
                return
            offset += limit

    def list(self, state: str | None = None, content_type: str | None = None, limit: int = 50, offset: int = 0) -> tuple[int, list[str] | str]:
        if limit < 1 or offset < 0:
            return 400, "limit must be at least 1 and offset not negative"
        if (state and state not in STATES) or (content_type and content_type not in CONTENT_TYPES):
            return 400, "no such state or content type"
        return 200, [r["json"] for r in to_json(catalog.list_torrents(self.tables["torrents"], state or None, content_type or None, limit, offset)).collect()]

    def get(self, infohash: str) -> tuple[int, str]:
        got = to_json(catalog.get(self.tables["torrents"], infohash)).head()
        return (200, got["json"]) if got else (404, "not found")

    def patch(self, infohash: str, state: str) -> tuple[int, str]:
        if state not in STATES:
            return 400, "no such state"
        if catalog.get(self.tables["torrents"], infohash).isEmpty():
            return 404, "not found"
        self._keep({"torrents": dml.set_state(self.tables["torrents"], infohash, state)})
        return 204, ""

    def delete(self, infohash: str) -> tuple[int, str]:
        if catalog.get(self.tables["torrents"], infohash).isEmpty():
            return 404, "not found"
        self._keep(dml.delete_cascade(self.tables, catalog.get(self.tables["torrents"], infohash)))
        return 204, ""

    def health(self) -> tuple[int, str]:
        """Whether the catalogue can be read."""
        try:
            self.tables["torrents"].limit(1).count()
        except Exception as e:
            return 503, str(e).splitlines()[0]
        return 200, "ok"
