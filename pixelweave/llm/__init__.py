"""Text, vector and link operators for the training-data side of a node-graph corpus.

Nothing outside this package imports it. The records are the project's own: the text outputs and
settings of graph nodes (``node_id``, ``node_type``, ``text``), the events of a node's chat runs,
image signatures (``image_id``, ``signature``) and the result links of nodes (``node_id``, ``url``).
"""
