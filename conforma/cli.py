"""Command line: compare ensembles and print the comparisons as JSON."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.bootstrap import S_NUM, SAMPLE_SIZE
from .operators.density import GRID
from .session import EnsembleSession
from .sources.sinks import results_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="conforma", description="Compare ensembles of structures on Spark.")
    p.add_argument("-traj", "--trajectories", required=True, help="paths with commas between, or a pattern")
    p.add_argument("-top", "--topology", required=True, help="a PDB file")
    p.add_argument("-m", "--measures", default="cbcn", help="of cbcn, cacn, caba, cata, sasa; commas between")
    p.add_argument("-r", "--ref", type=int, default=0, help="place of the reference ensemble")
    p.add_argument("-o", "--output-dir", default=".", help="folder in which a folder <measure>_output is made for each measure")
    p.add_argument("-d", "--dimred", default="pca,mds,tsne", help="of pca, mds, tsne; or none")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--x-num", type=int, default=GRID)
    p.add_argument("--s-num", type=int, default=S_NUM)
    p.add_argument("--sample-size", type=int, default=SAMPLE_SIZE)
    p.add_argument("--seed", type=int, default=0)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("conforma").getOrCreate()
    session = EnsembleSession(spark, a.trajectories, a.topology, a.output_dir, a.verbose, single_files=True)
    found = session.compare(a.measures, a.ref, a.x_num, a.s_num, a.dimred, a.sample_size, a.seed)
    sys.stdout.write(results_json(found) + "\n")
    session.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
