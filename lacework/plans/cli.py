"""Command line: python -m lacework.plans.cli puc|gb CONFIG.yml"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .config import BoostConfig, PucConfig, read_config
from .workflow import BoostWorkflow, PucWorkflow


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in ("puc", "gb"):
        print(__doc__)
        return 2
    config, workflow = (PucConfig, PucWorkflow) if args[0] == "puc" else (BoostConfig, BoostWorkflow)
    given = read_config(args[1], config)
    workflow(SparkSession.builder.getOrCreate(), given).run()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
