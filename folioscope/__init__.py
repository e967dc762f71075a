"""Analytics over catalogs of page images, and over the text that such corpora carry, on Spark."""
