"""A report page from a few small tables."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

ROWS = 200
STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}"


def page(title: str, tables: dict[str, DataFrame], rows: int = ROWS) -> str:
    """One self-contained page; each table shows its first rows, and says so if there are more."""
    out = [f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><style>{STYLE}</style><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        got = df.limit(rows + 1).collect()
        out.append(f"<h2>{escape(name)}</h2><table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in df.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in got[:rows]]
        out.append("</table>" + (f"<p>The first {rows} rows.</p>" if len(got) > rows else ""))
    return "\n".join(out)


def dashboard(usage: DataFrame, savings: DataFrame, registry: DataFrame, ledger: DataFrame, as_of: str, title: str = "Token economics") -> str:
    """The report of spend and of the ledger: what projects, models and days cost, what was saved, what to rightsize, who runs, and what the gates did."""
    from ..operators import finops

    return page(
        title,
        {
            "Cost by project": finops.top_projects(usage, as_of),
            "Cost by model": finops.cost_report(usage, as_of, by="model").orderBy("grp"),
            "Cost by day": finops.cost_by_day(usage, as_of).orderBy("day"),
            "Savings by source": finops.savings_by_source(savings, as_of).orderBy("source"),
            "Rightsizing": finops.rightsizing(usage, as_of).orderBy("project", "model"),
            "Agents by project": finops.registry_counts(registry).orderBy("project"),
            "Ledger": finops.ledger_totals(ledger),
            "Ledger by tier": finops.by_tier(ledger).orderBy("tier"),
            "Ledger by reason": finops.by_reason(ledger).orderBy("reason_code"),
        },
    )
