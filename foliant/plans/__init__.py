"""The registered queries over the given tables; importing this package registers them."""

from foliant.plans import bibliography, notes, pages, pipeline, relations, scripts, text

FLAGSHIP = "paragraph_explode"
