"""tokloom: corpus preparation and tokenizer analytics as Spark DataFrame jobs.

Every public function takes DataFrames (or a session plus a table directory) and
returns DataFrames; nothing keeps global state. See README.md for the layout.
"""

__version__ = "0.1.0"
