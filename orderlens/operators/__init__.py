"""DataFrame -> DataFrame building blocks: cleaning, the longest-prefix code
match, the star-schema model, checked broadcasts and the distributed global
rank / running sum / exact quantile helpers."""
