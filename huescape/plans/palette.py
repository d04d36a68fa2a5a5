"""The whole analysis as a set of relations over any number of images, each made from the ones before it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame

from ..functions.names import Names
from ..operators import adjacency, bins, gradients, render, synthesis
from ..store import Stored, carried


_PIXELS = ("chroma_stats", "directional", "coherence")
_ALL = (_PIXELS, ("significance", "gradients", "families"), ("notable_colors",))
#: relation: groups of stored relations to work out first, each group at once. No two of a group need one that is in none.
BEFORE = (
    dict.fromkeys(("neighbour_metrics", "color_metrics", "flow_edges", "flow_lists", "seed_scores", "flow_chains", "deduped_chains", "gradients", "gradient_membership", "significance", "selected"), (_PIXELS,))
    | {"family_span": (_PIXELS, ("gradients", "families")), "notable_colors": _ALL[:2], "contrast_pairs": _ALL[:2], "harmonic_pairs": _ALL[:2], "distribution": _ALL[:2], "summary": (_PIXELS, ("significance", "gradients", "families"))}
    | dict.fromkeys(("prose", "html"), (*_ALL, ("contrast_pairs", "harmonic_pairs", "summary")))
)


class Palette:
    """Relations of pixels(image_id, y, x, r, g, b); each is planned when it is first asked for.

    keep: write what several later relations read (bins, directed edges, coherence, gradients, notable colours) to the
    shared folder. That costs a job each, but plans stay short and nothing is worked out twice; release() deletes it.
    All relations carry image_id, so many images are one plan."""

    def __init__(self, pixels: DataFrame, names: Names | None = None, keep: bool = False, paths: DataFrame | None = None):
        self.pixels, self.names, self.keep, self.paths, self._kept = pixels, names, keep, paths, []

    def _hold(self, df: DataFrame, name: str) -> DataFrame:
        if not self.keep:
            return df
        table = Stored(df, f"palette-{name}")
        self._kept.append(table)
        return table.df

    def prepare(self, relation: str) -> Palette:
        """Works out the stored relations that `relation` rests on, those that don't need each other at the same time:
        an image's relations are small, so one job after the other would leave most of a cluster waiting."""
        if self.keep:
            for group in BEFORE.get(relation, ()):
                with ThreadPoolExecutor(len(group)) as pool:
                    for done in [pool.submit(carried(getattr), self, name) for name in group]:
                        done.result()
        return self

    def release(self) -> None:
        for table in self._kept:
            table.drop()
        self._kept = []

    @cached_property
    def lab_pixels(self) -> DataFrame:
        return bins.binned(self.pixels)

    @cached_property
    def images(self) -> DataFrame:
        return bins.images(self.lab_pixels)

    @cached_property
    def banded(self) -> DataFrame:
        return adjacency.bands(self.lab_pixels)

    @cached_property
    def fine_bins(self) -> DataFrame:
        return self._hold(bins.fine_bins(self.lab_pixels), "fine_bins")

    @cached_property
    def coarse_bins(self) -> DataFrame:
        return self._hold(bins.coarse_bins(self.fine_bins), "coarse_bins")

    @cached_property
    def color_names(self) -> DataFrame:
        return bins.named(self.coarse_bins, self.names)

    @cached_property
    def stability(self) -> DataFrame:
        return bins.stability(self.fine_bins)

    @cached_property
    def chroma_stats(self) -> DataFrame:
        return self._hold(bins.chroma_stats(self.coarse_bins), "chroma_stats")

    @cached_property
    def family_members(self) -> DataFrame:
        return bins.family_members(self.coarse_bins, self.chroma_stats)

    @cached_property
    def families(self) -> DataFrame:
        return self._hold(bins.families(self.family_members), "families")

    @cached_property
    def directional(self) -> DataFrame:
        return self._hold(adjacency.directional(self.banded), "directional")

    @cached_property
    def adjacency(self) -> DataFrame:
        return adjacency.adjacency(self.directional)

    @cached_property
    def neighbours(self) -> DataFrame:
        return adjacency.neighbours(self.adjacency)

    @cached_property
    def neighbour_metrics(self) -> DataFrame:
        return adjacency.neighbour_metrics(self.coarse_bins, self.neighbours)

    @cached_property
    def coherence(self) -> DataFrame:
        return self._hold(adjacency.coherence(self.lab_pixels), "coherence")

    @cached_property
    def color_metrics(self) -> DataFrame:
        return adjacency.color_metrics(self.coarse_bins, self.neighbour_metrics, self.coherence)

    @cached_property
    def flow(self) -> DataFrame:
        return gradients.flow(self.directional)

    @cached_property
    def flow_edges(self) -> DataFrame:
        return self._hold(gradients.flow_edges(self.flow, self.coherence), "flow_edges")

    @cached_property
    def flow_lists(self) -> DataFrame:
        return gradients.flow_lists(self.flow_edges)

    @cached_property
    def lab_extremes(self) -> DataFrame:
        return gradients.lab_extremes(self.fine_bins)

    @cached_property
    def seed_scores(self) -> DataFrame:
        return self._hold(gradients.seed_scores(self.fine_bins, self.coarse_bins, self.flow_edges, self.lab_extremes, self.coherence), "seed_scores")

    @cached_property
    def flow_chains(self) -> DataFrame:
        return self._hold(gradients.flow_chains(self.flow_lists, self.seed_scores), "flow_chains")

    @cached_property
    def deduped_chains(self) -> DataFrame:
        return gradients.deduped(self.flow_chains)

    @cached_property
    def gradients(self) -> DataFrame:
        return self._hold(gradients.gradients(self.deduped_chains), "gradients")

    @cached_property
    def gradient_membership(self) -> DataFrame:
        return gradients.gradient_membership(self.gradients)

    @cached_property
    def family_span(self) -> DataFrame:
        return gradients.family_span(self.gradients, self.coarse_bins, self.families)

    @cached_property
    def significance(self) -> DataFrame:
        return self._hold(synthesis.significance(self.color_metrics, self.stability, self.chroma_stats), "significance")

    @cached_property
    def selected(self) -> DataFrame:
        return synthesis.selected(self.significance)

    @cached_property
    def notable_colors(self) -> DataFrame:
        return self._hold(synthesis.notable_colors(self.significance, self.selected, self.gradient_membership, self.names), "notable_colors")

    @cached_property
    def contrast_pairs(self) -> DataFrame:
        return self._hold(synthesis.contrast_pairs(self.notable_colors), "contrast_pairs")

    @cached_property
    def harmonic_pairs(self) -> DataFrame:
        return self._hold(synthesis.harmonic_pairs(self.notable_colors), "harmonic_pairs")

    @cached_property
    def distribution(self) -> DataFrame:
        return synthesis.distribution(self.notable_colors)

    @cached_property
    def summary(self) -> DataFrame:
        return self._hold(synthesis.scheme(self.families, self.chroma_stats, self.distribution), "summary")

    @cached_property
    def prose(self) -> DataFrame:
        return render.prose(self.summary, self.notable_colors, self.gradients, self.contrast_pairs, self.harmonic_pairs, self.names)

    @cached_property
    def html(self) -> DataFrame:
        return render.html(self.summary, self.notable_colors, self.gradients, self.contrast_pairs, self.harmonic_pairs, self.paths, self.names)
