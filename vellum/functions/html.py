"""HTML to Markdown with the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements without content, elements left out, elements that an equal or listed one ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "head", "template", "noscript"}
ENDED_BY = {"p": {"p", "ul", "ol", "table", "div", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
WRAP = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "code": "`"}
BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "figure", "body", "html"}


class _Open:
    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.attrs, self.parts, self.rows = tag, attrs, [], []


class Writer(HTMLParser):
    """Keeps the open elements on a stack; one that closes is written into the one around it, so depth costs no recursion."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Open("", {})]

    def _inside(self, *tags: str) -> bool:
        return any(e.tag in tags for e in self.open)

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and tag in ENDED_BY.get(self.open[-1].tag, ()):
            self._close()
        if tag in VOID:
            given = dict(attrs)
            out = {"br": "  \n", "hr": "\n\n---\n\n", "img": f"![{given.get('alt') or ''}]({given.get('src') or ''})"}
            self.open[-1].parts.append(out.get(tag, ""))
        else:
            self.open.append(_Open(tag, dict(attrs)))

    def handle_endtag(self, tag):
        if any(e.tag == tag for e in self.open[1:]):
            while self._close() != tag:
                pass

    def handle_data(self, data):
        if not self._inside("pre"):
            data = re.sub(r"\s+", " ", data)
            if not self._inside("code"):
                data = re.sub(r"([*_])", r"\\\1", data)
        self.open[-1].parts.append(data)

    def _close(self) -> str:
        e = self.open.pop()
        around = self.open[-1]
        text = "".join(e.parts)
        core = text.strip()
        if e.tag in HIDDEN:
            out = ""
        elif e.tag in WRAP:
            mark = "" if self._inside("pre") else WRAP[e.tag]
            lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
            out = f"{lead}{mark}{core}{mark}{tail}" if core else text
        elif e.tag == "a":
            href = e.attrs.get("href")
            out = text if not href or not core else f"<{href}>" if core == href else f"[{core}]({href})"
        elif re.fullmatch("h[1-6]", e.tag):
            line = re.sub(r"\s+", " ", core)
            out = f"\n\n{'#' * int(e.tag[1])} {line}\n\n" if line else ""
        elif e.tag == "pre":
            out = "\n\n```\n" + text.strip("\n") + "\n```\n\n"
        elif e.tag == "blockquote":
            out = "\n\n" + "\n".join(f"> {x}".rstrip() for x in _tidy(text).split("\n")) + "\n\n"
        elif e.tag == "li":
            around.rows.append(_tidy(text))
            out = ""
        elif e.tag in ("ul", "ol"):
            marks = [f"{i}. " if e.tag == "ol" else "* " for i in range(1, len(e.rows) + 1)]
            items = [m + r.replace("\n", "\n" + " " * len(m)) for m, r in zip(marks, e.rows, strict=True)]
            gap = "\n" if around.tag == "li" else "\n\n"
            out = gap + "\n".join(items) + gap if items else ""
        elif e.tag in ("td", "th"):
            around.rows.append(re.sub(r"\s+", " ", core).replace("|", "\\|"))
            out = ""
        elif e.tag == "tr":
            around.rows.append(e.rows)
            out = ""
        elif e.tag in ("thead", "tbody", "tfoot"):
            around.rows.extend(e.rows)
            out = ""
        elif e.tag == "table":
            out = _table([r for r in e.rows if isinstance(r, list)])
        elif e.tag in BLOCK:
            out = f"\n\n{core}\n\n" if core else ""
        else:
            out = text
        around.parts.append(out)
        return e.tag

    def result(self) -> str:
        self.close()
        while len(self.open) > 1:
            self._close()
        return _tidy("".join(self.open[0].parts))


def _tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n (?! )", "\n", text) if "```" not in text else text).strip()


def _table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
    return "\n\n" + "\n".join(lines) + "\n\n"


def to_markdown(html: str | None) -> str:
    """Markdown with ATX headings; null and empty give an empty text. Heads, scripts and styles are left out."""
    w = Writer()
    w.feed(html or "")
    return w.result()


@F.pandas_udf(StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown)
