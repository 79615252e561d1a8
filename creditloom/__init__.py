"""creditloom: loan-portfolio feature, quality and modelling operators for PySpark."""
