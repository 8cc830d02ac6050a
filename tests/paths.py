"""Where the tests find the smallest tables."""

SF_SMALL = "/root/testdata/sf0.001"
