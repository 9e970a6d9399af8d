"""Short documents from small results: Markdown tables and one HTML page.  Every value is escaped; null shows as a dash."""
from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

ROWS = 200  # a report's table shows that many rows and says how many there are


def shown(value) -> str:
    if value is None:
        return "—"
    if isinstance(value, float):
        return f"{value:.4g}"
    return ", ".join(map(shown, value)) if isinstance(value, (list, tuple)) else str(value)


def table(df: DataFrame) -> tuple[list[str], list[list[str]], int]:
    total = df.count()
    return df.columns, [[shown(v) for v in row] for row in df.limit(ROWS).collect()], total


def markdown(title: str, sections: dict[str, DataFrame]) -> str:
    out = [f"# {title}", ""]
    for name, df in sections.items():
        columns, rows, total = table(df)
        safe = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
        out += [f"## {name}", "", safe(columns), "|" + "---|" * len(columns), *map(safe, rows), ""]
        out += [f"{len(rows)} of {total} rows.", ""] * (total > len(rows))
    return "\n".join(out)


def page(title: str, sections: dict[str, DataFrame], lang: str = "en") -> str:
    body = []
    for name, df in sections.items():
        columns, rows, total = table(df)
        head = "".join(f"<th>{escape(c)}</th>" for c in columns)
        lines = "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in row) + "</tr>" for row in rows)
        body.append(f"<section><h2>{escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{lines}</tbody></table><p>{len(rows)} / {total}</p></section>")
    return f'<!doctype html><html lang="{escape(lang)}"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{"".join(body)}</body></html>'


def annotate(text: str, glossary: dict[str, str]) -> str:
    """Escaped text with the first place of each term explained; longer terms win over those inside them."""
    import re

    if not glossary:
        return escape(text)
    terms = sorted(glossary, key=lambda t: (-len(t), t))
    seen: set[str] = set()

    def mark(m: re.Match) -> str:
        term = next(t for t in terms if t.lower() == m[0].lower())
        if term in seen:
            return escape(m[0])
        seen.add(term)
        return f'<abbr title="{escape(glossary[term])}">{escape(m[0])}</abbr>'

    out, last = [], 0
    for m in re.finditer("|".join(map(re.escape, terms)), text, re.I):
        out += [escape(text[last : m.start()]), mark(m)]
        last = m.end()
    return "".join(out) + escape(text[last:])
