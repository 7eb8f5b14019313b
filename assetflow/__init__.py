"""assetflow: curation of files, documents and detection records as Spark DataFrames.

Every public function takes and returns DataFrames or Columns.  Nothing is
collected to the driver; all work is declared with the DataFrame API so that
Catalyst can prune, push down and plan it.
"""

__version__ = "0.1.0"
