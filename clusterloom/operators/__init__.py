"""The jobs: clustering, subsets, tests, similarity, scans and process trees."""
