"""The query modules of the core."""

from siltstone.plans import graphs, panels, requests, reviews, streams, texts

MODULES = [graphs, texts, reviews, panels, streams, requests]
