"""cloudloom: point clouds, triangle meshes and pixel tables as Spark DataFrames.

A cloud is a DataFrame with a key `idx` and coordinates `x, y, z`; a mesh is `vertices` and `faces`; an image is a table
of pixels. All relational operators are lazy DataFrame transformations; kernels that are not relational run as grouped
Arrow or pandas functions, one group per cloud or image.
"""
