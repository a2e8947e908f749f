"""Site-corpus analytics on Spark: URLs, links, text surfaces, markers and coverage."""

from .operators.detect import canonical, extract, header_sightings, loose_hits, sightings, strict_hits
from .operators.surfaces import expanded
from .rules import HANDLERS, Rules

__all__ = ["HANDLERS", "Rules", "canonical", "expanded", "extract", "header_sightings", "loose_hits", "sightings", "strict_hits"]
