"""Statistics of documents whose texts were read and labelled by hand: 1 for lists, tables and junk, 0 for prose.

They calibrate the trees of problem 5 and are never trained on. The order is that of `quality.STATISTICS`.
"""

CHECKED: tuple[tuple[float, ...], ...] = (
    (0, 271, 5.085, 0.04199, 0.05381, 0.9042, 0.2121, 0.4945, 0.1515, 46.18, 0.1144, 0, 0, 0.3333, 0, 0.3321, 0, 12.32, 0.02559, 0.00853, 0.1161, 0),
    (0, 1669, 5.166, 0.03526, 0.01758, 0.9472, 0.6429, 0.4829, 0.2143, 216.7, 0.03859, 0.0005992, 0.07143, 0.02381, 0.1667, 0.08808, 0, 15.45, 0.001868, 0.03537, 0.003405, 0.01868),
    (0, 587, 5.487, 0.04059, 0.02551, 0.9339, 0.2759, 0.4395, 0.05172, 59.47, 0.04241, 0, 0.08621, 0.3103, 0, 0.1618, 0, 9.623, 0.0005799, 0.1551, 0.00116, 0),
    (0, 990, 5.316, 0.02702, 0.01868, 0.9543, 0.1154, 0.4737, 0.05128, 35.35, 0.0444, 0, 0, 0.2436, 0, 0.06162, 0, 18.68, 0.001269, 0.002357, 0.03536, 0),
    (0, 299, 5.271, 0.02337, 0.00738, 0.9692, 0.2105, 0.4849, 0.1316, 42.79, 0.02288, 0, 0, 0.1316, 0, 0.07692, 0, 17.59, 0.001845, 0.02337, 0.00492, 0),
    (0, 68, 5.353, 0.02918, 0.005305, 0.9655, 0.2, 0.4706, 0.4, 37.7, 0.01449, 0, 0, 0.3, 0, 0.1176, 0, 17, 0.005305, 0.07162, 0.02122, 0),
    (0, 134, 5.172, 0.02643, 0.009736, 0.9638, 0.1176, 0.4627, 0.1765, 42.29, 0.04286, 0, 0, 0.3529, 0, 0.08955, 0, 19.14, 0.004172, 0.01669, 0.01113, 0),
    (0, 1016, 5.02, 0.02463, 0.009094, 0.9663, 0.1373, 0.4833, 0.09804, 51.75, 0.02775, 0.0009843, 0, 0.2745, 0, 0.06693, 0, 18.14, 0.001516, 0, 0.007768, 0),
    (0, 437, 5.378, 0.02439, 0.004134, 0.9715, 0.1795, 0.5034, 0.05128, 62.03, 0.01354, 0, 0, 0.4615, 0, 0.05721, 0, 18.21, 0.0008268, 0, 0, 0),
    (0, 161, 4.839, 0.06488, 0.06376, 0.8714, 0.1379, 0.4286, 0.1724, 30.83, 0.04167, 0, 0, 0.2414, 0, 0.09317, 0, 20.12, 0.002237, 0.04139, 0.01342, 0.1029),
    (0, 417, 5.118, 0.02495, 0.006806, 0.9682, 0.1167, 0.4988, 0.05, 36.73, 0.02342, 0, 0, 0.2333, 0, 0.06235, 0, 17.38, 0.001361, 0, 0, 0),
    (0, 639, 5.191, 0.02431, 0.004101, 0.9716, 0.2, 0.5023, 0.09091, 62.07, 0.01236, 0, 0, 0.3455, 0, 0.0579, 0, 17.27, 0.0008787, 0, 0, 0),
    (0, 372, 5.358, 0.02381, 0.007775, 0.9684, 0.1892, 0.4973, 0.1081, 55.62, 0.02872, 0, 0, 0.2162, 0, 0.06989, 0, 16.17, 0.0009718, 0.006803, 0, 0),
    (0, 791, 5.153, 0.03344, 0.01333, 0.9532, 0.2368, 0.4665, 0.06579, 56.26, 0.03064, 0, 0.02632, 0.3421, 0, 0.09482, 0, 14.12, 0.001637, 0.002806, 0, 0),
    (0, 760, 5.228, 0.03431, 0.01906, 0.9466, 0.75, 0.4711, 0.2, 209.8, 0.04282, 0, 0.2, 0.05, 0, 0.1197, 0, 12.06, 0.001906, 0.1008, 0.002859, 0),
    (0, 760, 5.368, 0.02647, 0.0178, 0.9557, 0.1493, 0.4697, 0.02985, 31.86, 0.04161, 0, 0, 0.1791, 0, 0.06711, 0, 17.67, 0.000937, 0.002811, 0.03373, 0),
    (0, 258, 5.14, 0.02132, 0.003676, 0.975, 0.1556, 0.4845, 0.1111, 30.22, 0.01527, 0, 0, 0.1778, 0, 0.07364, 0, 18.43, 0.002206, 0.01765, 0, 0),
    (0, 176, 5.318, 0.02487, 0.005181, 0.9699, 0.1176, 0.5114, 0, 56.76, 0.01676, 0, 0, 0.5294, 0, 0.05682, 0, 17.6, 0.002073, 0, 0, 0),
    (0, 595, 5.348, 0.02407, 0.006399, 0.9695, 0.1364, 0.4706, 0.06818, 37.3, 0.02138, 0.001681, 0, 0.1932, 0, 0.06387, 0, 16.08, 0.0009141, 0, 0, 0),
    (0, 521, 5.313, 0.02454, 0.004909, 0.9705, 0.1429, 0.4837, 0.03571, 50.93, 0.01698, 0, 0, 0.3571, 0, 0.07486, 0, 16.81, 0.003156, 0, 0, 0),
    (0, 598, 5.135, 0.01901, 0.008236, 0.9728, 0.15, 0.4766, 0.1, 31.57, 0.02764, 0, 0.01, 0.14, 0, 0.0786, 0, 17.09, 0.002217, 0.01172, 0.0009503, 0),
    (0, 537, 5.207, 0.02857, 0.02041, 0.951, 0.1746, 0.46, 0.07937, 46.67, 0.04956, 0, 0, 0.2063, 0, 0.08194, 0, 17.9, 0.0006803, 0, 0.03912, 0),
    (0, 1251, 5.327, 0.03004, 0.0166, 0.9534, 0.1289, 0.4876, 0.05333, 31.07, 0.03769, 0, 0.008889, 0.16, 0.02222, 0.08153, 0, 15.84, 0.0008584, 0.03147, 0.0005722, 0.0166),
    (0, 1016, 5.357, 0.03385, 0.01657, 0.9496, 0.1733, 0.4695, 0.04, 38.21, 0.0333, 0, 0.03333, 0.22, 0, 0.1112, 0, 11.81, 0.001047, 0.08828, 0.0005234, 0),
    (0, 543, 5.05, 0.06552, 0.07492, 0.8596, 0.2222, 0.4494, 0.127, 50.63, 0.07338, 0, 0.07937, 0.3333, 0, 0.1657, 0, 9.203, 0.001567, 0.1665, 0.003762, 0.07649),
    (0, 458, 5.044, 0.06694, 0.07401, 0.8591, 0.2063, 0.452, 0.1905, 42.68, 0.08583, 0, 0.04762, 0.3492, 0.06349, 0.4039, 0, 8.808, 0.0238, 0.1272, 0.04723, 0.05653),
    (0, 799, 5.1, 0.06458, 0.07825, 0.8572, 0.1909, 0.4506, 0.1273, 43.22, 0.1102, 0, 0.04545, 0.3455, 0.1545, 0.3755, 0, 9.184, 0.02019, 0.1132, 0.06226, 0.05322),
    (0, 307, 5.322, 0.05291, 0.08254, 0.8646, 0.1944, 0.4788, 0.08333, 52.5, 0.168, 0, 0, 0.3333, 0, 0.3844, 0, 13.35, 0.01429, 0.01376, 0.2085, 0),
    (0, 591, 5.147, 0.04831, 0.05009, 0.9016, 0.2667, 0.4636, 0.12, 44.99, 0.08937, 0, 0.06667, 0.1467, 0.04, 0.1574, 0, 10.02, 0.002371, 0.1571, 0.06046, 0),
    (0, 416, 5.077, 0.05563, 0.06106, 0.8833, 0.25, 0.4952, 0.09615, 45.98, 0.113, 0, 0.05769, 0.3654, 0.05769, 0.3894, 0, 8.851, 0.02049, 0.12, 0.09661, 0),
    (1, 323, 5.746, 0.1121, 0.03183, 0.8561, 0.02941, 0.0743, 0.02941, 63.76, 0.03869, 0.006192, 0, 0, 0.1176, 0.1207, 0, 323, 0.1001, 0, 0, 0.9617),
    (1, 33, 7.03, 0.2467, 0.4728, 0.2805, 0, 0, 0.1818, 25.06, 0.7227, 0, 0, 0.2424, 0.7576, 0.1818, 0, 0, 0.02418, 0, 0.5272, 0.4728),
    (1, 93, 6.376, 0.25, 0.4819, 0.2681, 0, 0.01075, 0.3085, 23.53, 0.7, 0, 0, 0.2979, 0.4787, 0.1828, 0, 0, 0.01808, 0, 0.5199, 0.4801),
    (1, 1448, 4.974, 0.1335, 0.04125, 0.8253, 0.01829, 0.05732, 0.006098, 53.22, 0.05791, 0.3557, 0, 0.01829, 0.1463, 0.08287, 0, 120.7, 0.06955, 0, 0, 0.972),
    (1, 72, 8.181, 0.1776, 0.4337, 0.3888, 0, 0, 0.4667, 20.2, 0.7363, 0, 0, 0.08, 0.1467, 0.3611, 0, 0, 0.009241, 0, 0.8779, 0.1221),
    (1, 49, 6.49, 0.1984, 0.4306, 0.3711, 0, 0.06122, 0.2333, 28.57, 0.6142, 0, 0, 0.3667, 0, 0.3673, 0, 0, 0.004667, 0, 0.5461, 0.3606),
    (1, 393, 5.623, 0.1215, 0.1068, 0.7716, 0.4151, 0.1883, 0.4151, 54.04, 0.1457, 0, 0.9434, 0.01887, 0, 0.6285, 0, 2.911, 0.003841, 0.9728, 0, 0),
    (1, 2208, 4.691, 0.1518, 0.07297, 0.7752, 0.02929, 0.0462, 0, 55.91, 0.05802, 0.2794, 0.004184, 0, 0.1464, 0.2047, 0.006793, 96, 0.08891, 0, 0, 0.9932),
    (1, 45, 7.422, 0.1915, 0.4036, 0.4048, 0, 0.06667, 0.6842, 14.47, 0.7256, 0, 0, 0.01754, 0.1404, 0.5556, 0, 0, 0.004848, 0, 0.6824, 0.2255),
    (1, 105, 8.21, 0.1927, 0.4137, 0.3936, 0, 0, 0.2414, 25.17, 0.7388, 0, 0, 0, 0.8161, 0.2857, 0, 0, 0.02785, 0, 0.8475, 0.1525),
    (1, 257, 4.381, 0.1519, 0.1354, 0.7127, 0.03571, 0.09339, 0, 56.43, 0.07554, 0.3113, 0, 0.03571, 0.2143, 0.2568, 0.02724, 85.67, 0, 0, 0, 0.9525),
    (1, 217, 6.613, 0.1613, 0.05413, 0.7846, 0, 0.212, 0.4262, 29.98, 0.1589, 0, 0.3934, 0.3607, 0, 0.4055, 0, 21.7, 0.005467, 0.6134, 0, 0),
    (1, 162, 6.883, 0.2505, 0.05483, 0.6947, 0, 0.1852, 0.2979, 34.15, 0.198, 0, 0.2766, 0.3404, 0, 0.5802, 0, 10.8, 0.004984, 1, 0, 0),
    (1, 178, 6.669, 0.1526, 0.02427, 0.8232, 0.03774, 0.1798, 0.434, 27.21, 0.08718, 0, 0.3962, 0.3396, 0, 0.5449, 0, 17.8, 0.008322, 0.8883, 0, 0),
    (1, 412, 5.43, 0.1733, 0.1309, 0.6958, 0.4583, 0.2015, 0.02083, 66.98, 0.2152, 0, 0.4583, 0.3125, 0, 0.6553, 0, 2.861, 0.004355, 0.7991, 0, 0),
    (1, 1487, 5.734, 0.1744, 0.1013, 0.7243, 0.2638, 0.2098, 0.1957, 50.09, 0.1852, 0, 0.3787, 0.3745, 0, 0.6335, 0, 3.708, 0.002719, 0.9333, 0, 0),
    (1, 1262, 6.346, 0.1824, 0.1078, 0.7098, 0.1044, 0.1838, 0.2323, 37.99, 0.2448, 0, 0.2896, 0.4714, 0, 0.4945, 0, 5.44, 0.00195, 0.9821, 0, 0),
    (1, 607, 6.069, 0.2218, 0.07571, 0.7025, 0.1, 0.2438, 0.3462, 40.34, 0.183, 0, 0.4692, 0.2154, 0, 0.4876, 0, 5.726, 0.003814, 0.6817, 0, 0),
    (1, 1415, 4.163, 0.2242, 0.09802, 0.6777, 0.03636, 0.06784, 0.006061, 52.68, 0.0912, 0.2686, 0.01212, 0, 0.2121, 0.1731, 0.005654, 108.8, 0.09181, 0, 0, 0.9865),
    (1, 1642, 4.345, 0.1424, 0.06847, 0.7892, 0.01235, 0.02497, 0, 55.81, 0.02725, 0.1181, 0, 0, 0.04938, 0.3752, 0.01096, 547.3, 0.2055, 0, 0, 0.9897),
    (1, 397, 6.116, 0.1874, 0.0859, 0.7267, 0.09195, 0.2217, 0.2529, 38.4, 0.2092, 0, 0.2989, 0.3563, 0, 0.5164, 0, 5.838, 0.004789, 0.9656, 0, 0),
    (1, 2510, 5.041, 0.1319, 0.08869, 0.7794, 0.02593, 0.05618, 0.003704, 60.13, 0.07037, 0.1785, 0.01852, 0.007407, 0.1407, 0.2291, 0.01474, 119.5, 0.05161, 0, 0, 0.9825),
    (1, 497, 5.907, 0.1821, 0.09742, 0.7205, 0.1546, 0.2274, 0.2268, 42.01, 0.2048, 0, 0.2474, 0.4742, 0, 0.5292, 0, 5.287, 0.002699, 0.8449, 0, 0),
    (1, 295, 7.62, 0.01026, 0.02864, 0.9611, 0.03226, 0.02712, 0.03226, 75.45, 0, 0.04068, 0, 0, 0, 0.122, 0.01356, 295, 0.002138, 0, 0, 0.9654),
)
