"""Structure and curve analytics over archives of modelling runs, on Spark."""
