"""Modal analysis of rotationally periodic structures as Spark dataflow.

Meshes, sparse matrices, operating conditions and modes are DataFrames. Relational steps are
DataFrame operations that Catalyst plans; dense linear algebra runs as grouped-map kernels,
one group per operating condition and harmonic.
"""
