"""python -m huescape.cli -i IMAGE [-o [REPORT.html]] [--no-downscale] [--names FILE]"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .api import analyze_image
from .functions.names import read_names


#: Exit code and message of what a user can mend. Anything else is a fault of the program and shows where it came from.
EXITS = {KeyboardInterrupt: (130, ""), OSError: (1, "Error: {}"), ValueError: (1, "Error: {}")}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="huescape", description="The colour palette of an image.")
    p.add_argument("-i", "--input", required=True, help="image file")
    p.add_argument("-o", "--output", nargs="?", const="", help="write an HTML report, beside the image if no path is given")
    p.add_argument("--no-downscale", action="store_true", help="use the image at full resolution")
    p.add_argument("--names", help="file of colour names (name, tab, #rrggbb)")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("huescape").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        names = read_names(spark, a.names) if a.names else None
        prose, html = analyze_image(spark, a.input, not a.no_downscale, names)
        print(prose)
        if a.output is not None:
            to = Path(a.output) if a.output else Path(a.input).with_name(f"{Path(a.input).stem}-palette.html")
            to.write_text(html, encoding="utf-8")
            print(f"Wrote {to}")
    except tuple(EXITS) as e:
        code, said = next(v for kind, v in EXITS.items() if isinstance(e, kind))
        if said:
            print(said.format(e), file=sys.stderr)
        return code
    return 0


if __name__ == "__main__":
    sys.exit(main())
