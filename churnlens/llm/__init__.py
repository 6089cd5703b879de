"""Training-data operators: formatting, counting, deduplication, search, packing.

One module per operator; ``queries`` registers one query per operator and
``oracle`` the DuckDB SQL of those that SQL can express. Nothing outside this
package imports it.
"""
