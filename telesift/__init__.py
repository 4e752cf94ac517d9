"""Label-free feature selection and cluster explanation on Spark DataFrames."""
