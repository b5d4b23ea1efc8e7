"""Training-data operators: scoring, near-duplicate detection, scrubbing, packing, archives.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; column names of the input are parameters, and each operator
selects just the columns it needs first, so extra columns never clash.
"""
