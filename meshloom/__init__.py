"""meshloom: analytics over three-dimensional triangle meshes, on Spark DataFrames."""
