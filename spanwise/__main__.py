"""python -m spanwise COMMAND TABLES [--out PATH]: a query of the catalogue by name, or the list of them."""

from __future__ import annotations

import argparse

from . import catalog
from .session import session

#: commands that stand for catalogue queries
ALIASES = {
    "run": "metrics_summary", "report": "recommend", "abstain": "abstain_sweep", "abstain-report": "pick_threshold", "leaderboard": "leaderboard", "audit": "audit_rederive",
    "stress": "stress_matrix", "groundedness": "groundedness_rates", "agreement": "agreement", "validate": "validate_gold", "export": "beir_qrels", "bootstrap": "build_items", "lock": "corpus_lock",
}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="spanwise", description=__doc__)
    p.add_argument("command", help="list, " + ", ".join(ALIASES) + ", or the name of a query")
    p.add_argument("tables", nargs="?", help="directory of the Parquet tables")
    p.add_argument("--out", help="write Parquet here instead of showing rows")
    p.add_argument("--master", default=None)
    a = p.parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    name = ALIASES.get(a.command, a.command)
    if name not in catalog.QUERIES or not a.tables:
        p.error(f"no query {name!r}, or no tables given")
    df = catalog.QUERIES[name](session(a.master), a.tables)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(50, truncate=100)


if __name__ == "__main__":
    main()
