"""The comparison session: ensembles in, representations, comparisons, projections and figures out."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .model import normalise_measure, normalise_measures, normalise_techniques
from .operators.bootstrap import S_NUM, SAMPLE_SIZE
from .operators.compare import compare, comparison_records
from .operators.density import GRID
from .operators.measures import represent
from .operators.reduce import reduce
from .plans import figures
from .sources.sinks import output_dir, write_matrix_csv, write_matrix_png, write_projection_csv
from .sources.topology import read_topology
from .sources.trajectory import load_ensembles


class EnsembleSession:
    """Compare ensembles of one topology.

    trajectories: paths (a list, or a string with commas or a pattern), or a DataFrame of frames; topology: a PDB path, or a
    DataFrame of atoms. With output_dir, matrices and projections are written there, as folders of text parts, or with
    single_files as one file each, and a picture of each matrix. Results are kept by measure.
    """

    def __init__(self, spark: SparkSession, trajectories, topology, output_dir: str | None = None, verbose: bool = False, single_files: bool = False):
        self.spark, self.output_dir, self.verbose, self.single_files = spark, output_dir, verbose, single_files
        self.frames = trajectories if isinstance(trajectories, DataFrame) else load_ensembles(spark, trajectories)
        self.atoms = topology if isinstance(topology, DataFrame) else read_topology(spark, topology)
        self.representations: dict[str, DataFrame] = {}
        self.comparisons: dict[str, DataFrame] = {}
        self.projections: dict[str, dict[str, DataFrame]] = {}

    def _say(self, text: str) -> None:
        if self.verbose:
            print(text)

    def represent(self, measure: str) -> DataFrame:
        """Wide representation by a measure, kept in memory or on disk for the steps that read it again."""
        measure = normalise_measure(measure)
        if measure not in self.representations:
            self._say(f"computing {measure}")
            self.representations[measure] = represent(self.frames, self.atoms, measure).persist(StorageLevel.MEMORY_AND_DISK)
        return self.representations[measure]

    def compare(self, measures="cbcn", ref: int = 0, x_num: int = GRID, s_num: int = S_NUM, dimred=None, sample_size: int = SAMPLE_SIZE, seed: int = 0, on_degenerate: str = "error") -> dict[str, DataFrame]:
        """{measure: comparison records}; techniques in dimred also project all frames."""
        techniques, out = normalise_techniques(dimred), {}
        for measure in normalise_measures(measures):
            wide = self.represent(measure)
            compared = compare(wide, ref, x_num, s_num, sample_size, seed, on_degenerate=on_degenerate)
            self.comparisons[measure] = comparison_records(compared).persist(StorageLevel.MEMORY_AND_DISK)
            self.projections[measure] = {t: reduce(wide, t).persist(StorageLevel.MEMORY_AND_DISK) for t in techniques}
            if self.output_dir:
                folder = output_dir(measure, self.output_dir)
                for e in [r["ensemble"] for r in wide.select("ensemble").distinct().orderBy("ensemble").collect()]:
                    write_matrix_csv(wide, e, folder, self.single_files)
                    if self.single_files:
                        write_matrix_png(wide, e, folder)
                self.comparisons[measure].write.mode("overwrite").parquet(f"{folder}/comparisons.parquet")
                for t, df in self.projections[measure].items():
                    write_projection_csv(df, t, folder, self.single_files)
            out[measure] = self.comparisons[measure]
        return out

    def representation(self, measure: str) -> DataFrame | None:
        return self.representations.get(normalise_measure(measure))

    def comparison(self, measure: str) -> DataFrame | None:
        return self.comparisons.get(normalise_measure(measure))

    def projection(self, measure: str) -> dict[str, DataFrame] | None:
        return self.projections.get(normalise_measure(measure))

    def _needed(self, measure: str) -> DataFrame:
        found = self.comparison(measure)
        if found is None:
            raise ValueError(f"no comparison by {measure}; call compare first")
        return found

    def replot_global(self, measure: str, kind: str = "bar", **style) -> DataFrame:
        return figures.replot_global(self._needed(measure), kind, **style)

    def replot_local(self, measure: str, ensemble_index: int, **style) -> DataFrame:
        return figures.replot_local(self._needed(measure), ensemble_index, **style)

    def figures(self, measure: str) -> dict[str, DataFrame]:
        """All figures of a measure as tables."""
        records = self._needed(measure)
        out = {"heatmap": figures.heatmap_cells(self.represent(measure)), "heatmap_ticks": figures.heatmap_ticks(self.represent(measure)), "global_bar": figures.global_bars(records), "global_line": figures.global_line(records), "local": figures.local_lines(records)}
        return out | {f"scatter_{t}": figures.scatter(df) for t, df in self.projections.get(normalise_measure(measure), {}).items()}

    def close(self) -> None:
        for df in [*self.representations.values(), *self.comparisons.values(), *(d for p in self.projections.values() for d in p.values())]:
            df.unpersist()
